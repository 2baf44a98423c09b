"""The strict profile: one pinned key signs every record, the root is known, payloads are inline and hashed anew, and the first failure ends the run.

All checks but three are of a record alone; those three compare it with the one before. As everything before the first
failure is valid, a record's neighbour is simply the one before it in its block, or the last one of the block before. So
each block is read up to its own first failure, and the least of these in the log's order is the verdict.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import blake3, ed25519, messages, record
from ..functions.canonical import CanonicalError, canonical_json
from ..functions.record import Record
from ..functions.strict_json import JsonError, dumps, parse
from ..operators import splits
from ..operators.digest import ASCII_BLANK
from ..operators.root import chain_root
from ..sources import segments
from .reports import Outcomes, StrictReport, envelope

# Fixed values of the profile. The first bounds what a host page is given; a caller with a whole log of its own can lift it.
MAX_RECORDS = 100_000
MAX_LINE_BYTES = 1 << 20
MAX_PAYLOAD_BYTES = 64 << 10

#: Order of the checks: up to TYPING the record's own sequence isn't known; from VERSION on its version has been seen.
TOO_MANY, LINE_SIZE, SYNTAX, UNKNOWN_KEY, TYPING, VERSION, ALG, UNSIGNED, SIGNATURE_HEX, KEY_HEX, PIN, POINT, PAYLOAD, CANONICAL, PAYLOAD_SIZE, PAYLOAD_HASH, LINK, GAP, TIME, FORMAT, SIGNATURE = range(1, 22)

#: A failure: rank, kind, details as JSON fields of the reason.
Failure = tuple[int, str, dict[str, Any]]

_SIDE = "sequence string, ts long, hash string, line long"
_PART = f"name string, block long, part int, first_record long, lines long, filled long, records long, hashes binary, head struct<{_SIDE}>, tail struct<{_SIDE}>, failure struct<record long, line long, rank int, kind string, sequence string, version long, reason string>"
_P_SIDE = pa.struct([("sequence", pa.string()), ("ts", pa.int64()), ("hash", pa.string()), ("line", pa.int64())])
_P_FAILURE = pa.struct([("record", pa.int64()), ("line", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("sequence", pa.string()), ("version", pa.int64()), ("reason", pa.string())])


def _hex_text(text: str, size: int) -> str | None:
    """What is wrong with size hex digits."""
    got = len(text.encode())
    if got != size:
        return f"expected {size} hex chars, got {got}"
    for i, c in enumerate(text):
        if c not in "0123456789abcdefABCDEF":
            return f"Invalid character '{c}' at position {i}"
    return None


def decoded(line: bytes, iso: bool) -> tuple[Record | None, bool, Failure | None]:
    """The record of a line, whether it declares its version, or why it is none."""
    if len(line) > MAX_LINE_BYTES:
        return None, False, (LINE_SIZE, "line_too_large", {"bytes": len(line), "limit": MAX_LINE_BYTES})
    try:
        value = parse(line)
    except JsonError as e:
        return None, False, (SYNTAX, "parse_error", {"line": 0, "details": str(e)})
    if isinstance(value, dict) and (unknown := sorted(k for k in value if k not in record.FIELD_OF)):
        return None, False, (UNKNOWN_KEY, "unknown_field", {"field": unknown[0]})
    try:
        return record.record_of(value, iso=iso, repeats=True), "format_version" in value, None
    except JsonError as e:
        return None, False, (TYPING, "parse_error", {"line": 0, "details": str(e)})


def own_failure(r: Record, declared: bool, pin: bytes) -> Failure | None:
    """The first check up to the payload's hash that a record fails by itself."""
    if not declared or r.format_version != record.FORMAT_VERSION:
        return VERSION, "unsupported_format_version", {"found": r.format_version if declared else 0}
    if r.hash_alg is not None and r.hash_alg != record.HASH_ALG:
        return ALG, "unsupported_hash_alg", {"found": r.hash_alg}
    if r.signature is None or r.public_key is None:
        return UNSIGNED, "unsigned_record", {}
    if text := _hex_text(r.signature, 128):
        return SIGNATURE_HEX, "signature_malformed", {"details": text}
    if text := _hex_text(r.public_key, 64):
        return KEY_HEX, "pubkey_malformed", {"details": text}
    if bytes.fromhex(r.public_key) != pin:
        return PIN, "pubkey_mismatch", {}
    if r.payload is None:
        return PAYLOAD, "no_payload", {}
    try:
        canonical = canonical_json(r.payload)
    except CanonicalError as e:
        return CANONICAL, "non_canonical_payload", {"details": str(e)}
    if len(canonical) > MAX_PAYLOAD_BYTES:
        return PAYLOAD_SIZE, "payload_too_large", {"bytes": len(canonical), "limit": MAX_PAYLOAD_BYTES}
    r.payload = canonical  # for the hash, which is computed for many at a time
    return None


def link_failure(r: Record, before: tuple[str, int, int] | None) -> Failure | None:
    """before: entry hash, sequence and time of the record before; None at the log's first."""
    if before is None:
        if r.sequence != 1:
            return LINK, "invalid_genesis", {"expected": "sequence=1", "found": f"sequence={r.sequence}"}
        if r.prev_hash != record.GENESIS_PREV_HASH:
            return LINK, "invalid_genesis", {"expected": record.GENESIS_PREV_HASH, "found": r.prev_hash}
        return None
    link, last, then = before
    if r.prev_hash != link:
        return LINK, "chain_break", {"expected": link, "found": r.prev_hash}
    if r.sequence != last + 1:
        return GAP, "sequence_gap", {"previous": last, "missing": last + 1}
    if r.timestamp_ns < then:
        return TIME, "timestamp_regression", {"previous": then, "current": r.timestamp_ns}
    return None


REJECTED = frozenset("parse_error unsupported_format_version unsupported_hash_alg unsigned_record pubkey_mismatch signature_malformed pubkey_malformed no_payload payload_too_large line_too_large non_canonical_payload too_many_records unknown_field".split())


class StrictReader:
    """Reads a block up to its first failure."""

    def __init__(self, pin: bytes, iso: bool, most: int | None):
        self.pin, self.iso, self.most = pin, iso, most

    def open(self, name: str, block: int) -> None:
        self.name, self.block, self.part, self.line, self.filled, self.record = name, block, 0, 0, 0, 0
        self.before: tuple[str, int, int] | None = None
        self.ended = False

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def feed(self, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows: list[Record] = []
        at: list[int] = []
        stop: tuple[int, Record | None, Failure] | None = None  # line, record, failure
        filled = 0
        for i, line in enumerate(lines, self.line):
            if line[-1:] == b"\r":
                line = line[:-1]
            if not line.strip(ASCII_BLANK):
                continue
            filled += 1
            if self.ended or stop or self.most is not None and self.filled + filled > self.most + 1:
                continue
            r, declared, failure = decoded(line, self.iso)
            if r is not None:
                failure = own_failure(r, declared, self.pin)
            if failure:
                stop = i, r, failure
            else:
                rows.append(r)  # type: ignore[arg-type]
                at.append(i)
        head = None
        n = len(rows)
        if n:
            digests = blake3.hash_many([record.entry_message(r) for r in rows] + [record.sign_message(r) for r in rows] + [r.payload for r in rows])
            hexes = blake3.hexes(digests)
            good = 0
            for i, r in enumerate(rows):
                failure = None
                if hexes[2 * n + i] != r.payload_hash:
                    failure = PAYLOAD_HASH, "payload_hash_mismatch", {"declared": r.payload_hash, "computed": hexes[2 * n + i]}
                elif self.record + i:  # a block's first record waits for the block before
                    failure = link_failure(r, self.before if i == 0 else (hexes[i - 1], rows[i - 1].sequence, rows[i - 1].timestamp_ns))
                if failure is None and (problems := record.hash_problems(r)):
                    failure = FORMAT, "invalid_hash_format", {"details": "; ".join(problems)}
                if failure:
                    stop = at[i], r, failure
                    break
                good = i + 1
            own = rows[:good]
            ok = ed25519.verify_many([self.pin] * good, [record.STRICT_DOMAIN + h.encode() for h in hexes[n : n + good]], [bytes.fromhex(r.signature) for r in own])
            if not all(ok):
                good = ok.index(False)
                stop = at[good], rows[good], (SIGNATURE, "signature_verification_failed", {})
            seen = rows[0]
            if not self.record and (stop is None or good or stop[2][0] > PAYLOAD_HASH):
                head = {"sequence": str(seen.sequence), "ts": seen.timestamp_ns, "hash": seen.prev_hash, "line": at[0]}
            n = good
        tail = None
        if n:
            last = rows[n - 1]
            self.before = hexes[n - 1], last.sequence, last.timestamp_ns
            tail = {"sequence": str(last.sequence), "ts": last.timestamp_ns, "hash": hexes[n - 1], "line": at[n - 1]}
        failed = None
        if stop and not self.ended:
            line, r, (rank, kind, reason) = stop
            failed = {"record": self.record + n, "line": line, "rank": rank, "kind": kind, "sequence": str(r.sequence) if r else None, "version": r.format_version if r else None, "reason": dumps(reason, sort=False)}
            self.ended = True
        hashes = digests[:n].tobytes() if n else b""
        cols = [pa.array([self.name], pa.string()), pa.array([self.block], pa.int64()), pa.array([self.part], pa.int32()), pa.array([self.record], pa.int64()), pa.array([len(lines)], pa.int64()), pa.array([filled], pa.int64()), pa.array([n], pa.int64()), pa.array([hashes], pa.binary()), pa.array([head], _P_SIDE), pa.array([tail], _P_SIDE), pa.array([failed], _P_FAILURE)]
        yield pa.RecordBatch.from_arrays(cols, ["name", "block", "part", "first_record", "lines", "filled", "records", "hashes", "head", "tail", "failure"])
        self.line += len(lines)
        self.filled += filled
        self.record += n
        self.part += 1


def _error(report: StrictReport, text: str) -> StrictReport:
    report.status, report.error = "error", text
    return report


def verify_scan(scan: DataFrame, expected_pubkey: str, expected_root: str, manifest_version: int = 1, *, iso: bool = True, capped: bool = True) -> StrictReport:
    """capped: a log of more than MAX_RECORDS records is rejected, as the profile says; without, a log of any length is verified whole."""
    most = MAX_RECORDS if capped else None
    key_text, root = record.normalized_anchor(expected_pubkey), record.normalized_anchor(expected_root)
    out = StrictReport(verifier_version=__version__, manifest_version_used=manifest_version, expected_pubkey_fp=record.fingerprint(key_text))
    if problem := _hex_text(key_text, 64):
        return _error(out, messages.S_PUBKEY_HEX.format(why=problem))
    pin = bytes.fromhex(key_text)
    if ed25519.decompress(pin) is None:
        return _error(out, messages.S_PUBKEY_POINT)
    if _hex_text(root, 64):
        return _error(out, messages.S_ROOT_HEX.format(found=len(root.encode())))
    parts = splits.split_map(scan, lambda: StrictReader(pin, iso, most), _PART).persist()
    try:
        return _concluded(out, parts, root, most)
    finally:
        parts.unpersist()


def _concluded(out: StrictReport, parts: DataFrame, root: str, most: int | None) -> StrictReport:
    # a row a block up to the first failure
    rows = parts.groupBy("name", "block").agg(F.sum("lines").alias("lines"), F.sum("filled").alias("filled"), F.sum("records").alias("records"), F.expr("min_by(head, part) FILTER (WHERE head IS NOT NULL)").alias("head"), F.expr("max_by(tail, part) FILTER (WHERE tail IS NOT NULL)").alias("tail"), F.expr("min_by(failure, part) FILTER (WHERE failure IS NOT NULL)").alias("failure")).orderBy("name", "block")
    line = filled = n = 0
    before: tuple[str, int, int] | None = None
    failed: dict[str, Any] | None = None
    covered: list[tuple[str, int, int, int]] = []  # name, block, where its records begin, how many count
    for b in rows.toLocalIterator():
        if filled + b["filled"] == 0:
            line += b["lines"]
            continue
        own = b["records"]
        failure = b["failure"].asDict() if b["failure"] else None
        head = b["head"]
        if head is not None:
            first = Record(sequence=int(head["sequence"]), timestamp_ns=head["ts"], prev_hash=head["hash"])
            seam = link_failure(first, before)
            if seam and not (failure and failure["record"] == 0 and failure["rank"] < seam[0]):
                rank, kind, reason = seam
                failure, own = {"record": 0, "line": head["line"], "rank": rank, "kind": kind, "sequence": head["sequence"], "version": record.FORMAT_VERSION, "reason": dumps(reason, sort=False)}, 0
        room = b["filled"] if most is None else most - filled
        at = failure["record"] if failure else own
        if (b["filled"] > room) and at >= room:
            failure, own = {"record": room, "line": line, "rank": TOO_MANY, "kind": "too_many_records", "sequence": None, "version": None, "reason": f'{{"limit":{most}}}'}, room
        elif failure:
            own = failure["record"]
        covered.append((b["name"], b["block"], n, own))
        n += own
        if failure:
            failed = failure | {"line": line + failure["line"]}
            break
        if b["tail"] is not None:
            before = b["tail"]["hash"], int(b["tail"]["sequence"]), b["tail"]["ts"]
        line += b["lines"]
        filled += b["filled"]
    out.events_verified = out.signatures_verified = n
    out.wal_format_version_seen = max(record.FORMAT_VERSION if n else 0, (failed or {}).get("version") or 0)
    last = None
    if failed:
        kind = failed["kind"]
        reason = {"kind": kind} | json.loads(failed["reason"])
        if kind == "parse_error":
            reason["line"] = failed["line"] + 1
        sequence = int(failed["sequence"]) if failed["sequence"] is not None else n + 1
        last = {"sequence": sequence, "outcome": "rejected" if kind in REJECTED else "invalid", "reason": reason}
    out.records = Outcomes(n, last)
    out.chain_root = _root(parts, covered, n)
    if failed:
        out.status = "invalid"
    elif out.chain_root != root:
        out.status, out.error = "invalid", messages.S_ROOT.format(expected=root, found=out.chain_root)
    return out


def _root(parts: DataFrame, covered: list[tuple[str, int, int, int]], count: int) -> str:
    """The root of the records that count."""
    blocks = parts.sparkSession.createDataFrame(covered, "name string, block long, at long, own long")
    held = parts.where("records > 0").join(splits.small(blocks, len(covered)), ["name", "block"]).where("first_record < own")
    return chain_root(held.select((F.col("at") + F.col("first_record")).alias("start"), F.expr("substring(hashes, 1, int(32 * least(records, own - first_record)))").alias("hashes")), count)


def verify_directory(spark: SparkSession, directory: str, expected_pubkey: str, expected_root: str, manifest_version: int = 1, *, capped: bool = True) -> StrictReport:
    return verify_scan(segments.scan_directory(spark, directory), expected_pubkey, expected_root, manifest_version, capped=capped)


def verify_bytes(spark: SparkSession, data: bytes, expected_pubkey: str, expected_root: str, manifest_version: int = 1, parts: int = 1, *, iso: bool = True) -> StrictReport:
    return verify_scan(segments.scan_bytes(spark, data, parts), expected_pubkey, expected_root, manifest_version, iso=iso)


def verify_bytes_json(spark: SparkSession, data: bytes, expected_pubkey: str, expected_root: str, manifest_version: int = 1) -> str:
    """The report in the envelope of host pages, whose times are integers."""
    return envelope(verify_bytes(spark, data, expected_pubkey, expected_root, manifest_version, iso=False))
