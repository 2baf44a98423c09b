"""Makes a file of test vectors: the inputs are given, everything expected is computed, and the bytes are the same each time."""

from __future__ import annotations

import json
from typing import Any

import numpy as np

from ..functions import blake3, canonical, record, strict_json
from ..functions.ed25519 import SigningKey
from ..functions.record import Record
from ..sources.vectors import SCHEMA_VERSION
from . import vectors as V

_HASHED = ("sequence", "timestamp_ns", "prev_hash", "payload_hash", "event_type", "source", "signature", "public_key")


def _entry(values: tuple) -> tuple[dict[str, Any], Record]:
    given = dict(zip(_HASHED, values, strict=True))
    return given, Record(**given)


def canonical_cases() -> list[dict[str, Any]]:
    out = []
    for name, text, _, _ in V.CANONICAL:
        value = strict_json.parse(text.encode())
        out.append({"name": name, "input": value, "expected_canonical_json_utf8": canonical.canonical_text(value), "expected_payload_hash_blake3": canonical.payload_hash(value)})
    return out


def hash_cases(rows: list[tuple], message, expected: str) -> list[dict[str, Any]]:
    out = []
    for name, *values, _ in rows:
        given, r = _entry(tuple(values))
        out.append({"name": name, "input": given, expected: blake3.hexdigest(message(r))})
    return out


def chain_cases() -> list[dict[str, Any]]:
    """A chain whose links are computed from the first record's on, so one wrong hash shows in all later ones."""
    given, hashes, prev = [], [], record.GENESIS_PREV_HASH
    for sequence, ts, _, payload_hash, _ in V.CHAIN:
        values, r = _entry((sequence, ts, prev, payload_hash, None, None, None, None))
        prev = blake3.hexdigest(record.entry_message(r))
        given.append(values)
        hashes.append(prev)
    root = blake3.ListHash()
    root.extend(np.frombuffer(bytes.fromhex("".join(hashes)), np.uint8).reshape(-1, 32))
    return [{"name": "three_entry_unsigned_chain", "inputs": given, "expected_entry_hashes": hashes, "expected_root": root.digest().hex()}]


def receipt_cases() -> list[dict[str, Any]]:
    out = []
    for name, event, payload_hash, time, seq, key, alg, batch, _ in V.RECEIPT:
        given = {"event_id": event, "payload_hash": payload_hash, "server_time": time, "server_seq": seq, "receipt_sig": "", "server_key_id": key, "sig_alg": alg, "batch_id": batch}
        message = record.receipt_message(given)
        out.append({"name": name, "input": given, "expected_canonical_message_hex": message.hex(), "expected_canonical_message_utf8": message.decode()})
    return out


def signature_cases() -> list[dict[str, Any]]:
    key = SigningKey(bytes.fromhex(V.SEED))
    given, r = _entry((*V.SIGN[0][1:7], None, None))
    text = blake3.hexdigest(record.sign_message(r)).encode()
    out = []
    for name, profile, domain in (("lenient_no_domain_prefix", "lenient", b""), ("strict_domain_prefix", "strict", record.STRICT_DOMAIN)):
        message = domain + text
        out.append({"name": name, "profile": profile, "input": given, "signing_key_seed_hex": V.SEED, "public_key_hex": key.public.hex(), "signed_message_hex": message.hex(), "signature_hex": key.sign(message).hex()})
    return out


def make() -> bytes:
    sections = {
        "canonical_json": canonical_cases(),
        "entry_hash": hash_cases(V.ENTRY, record.entry_message, "expected_entry_hash"),
        "sign_hash": hash_cases(V.SIGN, record.sign_message, "expected_sign_hash"),
        "chain_root": chain_cases(),
        "receipt_canonical_message": receipt_cases(),
        "signature": signature_cases(),
    }
    whole: dict[str, Any] = {"schema_version": SCHEMA_VERSION, "wal_format_version": record.FORMAT_VERSION}
    whole |= {name: {"cases": cases} for name, cases in sections.items()}
    return (json.dumps(whole, indent=2, ensure_ascii=False) + "\n").encode()
