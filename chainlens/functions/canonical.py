"""Canonical JSON: NFC strings, keys in the order of their UTF-16 code units, no white space, safe integers only."""

from __future__ import annotations

import json
import unicodedata
from typing import Any

from . import blake3
from .strict_json import JsonError, parse, wide

SAFE = 2**53 - 1

_string = json.JSONEncoder(ensure_ascii=False).encode


class CanonicalError(ValueError):
    """kind: invalid_json, non_integer_number, number_out_of_range or duplicate_key_after_nfc."""

    # Message texts.
    TEXTS = {
        "invalid_json": "invalid JSON: {}",
        "non_integer_number": "non-integer number not supported in canonical JSON: {}",
        "number_out_of_range": "integer outside the safe range supported by canonical JSON (max magnitude 2^53-1): {}",
        "duplicate_key_after_nfc": "two object keys collide after NFC normalization: {}",
    }

    def __init__(self, kind: str, what: str):
        super().__init__(self.TEXTS[kind].format(what))
        self.kind = kind


def _nfc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def _utf16(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


def canonical_text(value: Any) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        return _string(_nfc(value))
    if isinstance(value, int):
        if wide(value):
            raise CanonicalError("non_integer_number", repr(float(value)))
        if abs(value) > SAFE:
            raise CanonicalError("number_out_of_range", str(value))
        return str(value)
    if isinstance(value, float):
        raise CanonicalError("non_integer_number", repr(value))
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_text, value)) + "]"
    by_key: dict[str, Any] = {}
    for k, v in value.items():
        k = _nfc(k)
        if k in by_key:
            raise CanonicalError("duplicate_key_after_nfc", json.dumps(k, ensure_ascii=False))
        by_key[k] = v
    keys = sorted(by_key) if all(map(str.isascii, by_key)) else sorted(by_key, key=_utf16)
    return "{" + ",".join([f"{_string(k)}:{canonical_text(by_key[k])}" for k in keys]) + "}"


def canonical_json(value: Any) -> bytes:
    """The canonical bytes of a value of strict_json.parse()."""
    return canonical_text(value).encode()


def canonical_json_from_bytes(data: bytes) -> bytes:
    try:
        value = parse(data)
    except JsonError as e:
        raise CanonicalError("invalid_json", str(e)) from None
    return canonical_json(value)


def payload_hash(value: Any) -> str:
    return blake3.hexdigest(canonical_json(value))
