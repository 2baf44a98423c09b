"""The lenient profile as a plain loop over lines, to hold the distributed one against. It shares no code with the digests."""

from chainlens.functions import blake3, ed25519, record
from chainlens.functions.strict_json import JsonError


class Stop(Exception):
    pass


def verify(data: bytes, *, selects=lambda seq: True, pin=None, keystore=None, fail_fast=False, root=None):
    out = {"errors": [], "warnings": 0, "events": 0, "signatures": 0, "skipped": 0, "receipts": 0, "first": None, "last": None, "halted": False}
    prev, hashes = None, []

    def fail(seq, kind):
        out["errors"].append((seq, kind))
        if fail_fast:
            out["halted"] = True
            raise Stop

    def advance(r):
        nonlocal prev
        h = blake3.hexdigest(record.entry_message(r))
        hashes.append(h)
        prev = (h, r.sequence, r.timestamp_ns)
        out["events"] += 1

    def one(r):
        out["first"] = out["first"] or (r.sequence, r.timestamp_ns)
        out["last"] = (r.sequence, r.timestamp_ns)
        if prev is None:
            if r.sequence != 1 or r.prev_hash != "0" * 64:
                fail(r.sequence, "invalid_genesis")
        else:
            if r.prev_hash != prev[0]:
                fail(r.sequence, "chain_break")
            if r.sequence != min(prev[1] + 1, 2**64 - 1):
                fail(r.sequence, "sequence_gap")
            if r.timestamp_ns < prev[2]:
                fail(r.sequence, "timestamp_regression")
        both, none = r.signature is not None and r.public_key is not None, r.signature is None and r.public_key is None
        if selects(r.sequence):
            if both:
                if pin is not None and record.unhex(r.public_key, 32) != pin:
                    fail(r.sequence, "untrusted_pubkey")
                    return advance(r)
                message = blake3.hexdigest(record.sign_message(r)).encode()
                if ed25519.verify(record.unhex(r.public_key, 32) or b"", message, record.unhex(r.signature, 64) or b""):
                    out["signatures"] += 1
                else:
                    fail(r.sequence, "invalid_signature")
            elif not none or pin is not None:
                fail(r.sequence, "unsigned_record")
        elif not none:
            out["skipped"] += 1
        if r.hash_alg not in (None, "blake3"):
            out["warnings"] += 1
        if keystore is not None and r.receipt is not None:
            x = r.receipt
            if x["sig_alg"] != "ed25519":
                fail(r.sequence, "receipt_unsupported_alg")
            elif x["server_key_id"] not in keystore:
                fail(r.sequence, "receipt_key_unknown")
            elif record.unhex(x["receipt_sig"], 64) is None:
                fail(r.sequence, "receipt_sig_malformed")
            elif not ed25519.verify(keystore[x["server_key_id"]], record.receipt_message(x), bytes.fromhex(x["receipt_sig"])):
                fail(r.sequence, "receipt_signature_invalid")
            elif x["payload_hash"] != r.payload_hash or r.event_id is not None and r.event_id != x["event_id"]:
                fail(r.sequence, "receipt_entry_mismatch")
            else:
                out["receipts"] += 1
        for _ in record.hash_problems(r):
            fail(r.sequence, "invalid_hash_format")
        advance(r)

    try:
        for line in data.split(b"\n"):
            line = line[:-1] if line.endswith(b"\r") else line
            if line.strip(b" \t\n\x0c\r"):
                try:
                    r = record.decode(line)
                except JsonError:
                    fail(None, "parse_error")
                    continue
                one(r)
    except Stop:
        pass
    out["root"] = blake3.hexdigest("".join(hashes).encode())
    if root and root != out["root"]:
        out["errors"].append((None, "root_mismatch"))
    return out


def as_loop(report) -> dict:
    """A report in the loop's terms."""
    return {
        "errors": [(e["sequence"], e["error_type"]) for e in report.errors],
        "warnings": sum("this profile computes blake3 only" in w for w in report.warnings),
        "events": report.events_verified,
        "signatures": report.signatures_verified,
        "skipped": report.signatures_skipped,
        "receipts": report.receipts_verified,
        "first": None if report.first_sequence is None else (report.first_sequence, report.first_timestamp),
        "last": None if report.last_sequence is None else (report.last_sequence, report.last_timestamp),
        "halted": report.halted_early,
        "root": report.chain_root,
    }
