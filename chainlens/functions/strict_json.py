"""JSON read strictly: no NaN, no lone surrogates, no deep nesting; integers and floats are told apart, repeated keys are seen."""

from __future__ import annotations

import json
import re
from typing import Any

#: Nesting that is still read.
DEPTH = 127
I64, U64 = (-(2**63), 2**63 - 1), (0, 2**64 - 1)


class JsonError(ValueError):
    """The text isn't JSON of this kind."""


class Repeated(dict):
    """An object in which a key occurs more than once; the last one counts. repeated: those keys."""

    def __init__(self, pairs: list[tuple[str, Any]]):
        super().__init__(pairs)
        seen: set[str] = set()
        self.repeated = {k for k, _ in pairs if k in seen or seen.add(k)}


def _object(pairs: list[tuple[str, Any]]) -> dict:
    d = dict(pairs)
    return d if len(d) == len(pairs) else Repeated(pairs)


def _float(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise JsonError(f"number out of range: {text[:40]}")
    return x


def _int(text: str) -> int | float:
    return -0.0 if text == "-0" else int(text)


def _constant(text: str) -> None:
    raise JsonError(f"{text} is not JSON")


_plain = json.JSONDecoder(object_pairs_hook=_object, parse_float=_float, parse_constant=_constant).decode
_wide = json.JSONDecoder(object_pairs_hook=_object, parse_float=_float, parse_int=_int, parse_constant=_constant).decode
_MINUS_ZERO = re.compile(r"(?:^|[:,\[\s])-0(?:[,\]}\s]|$)")
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def parse(data: bytes) -> Any:
    """The value of UTF-8 bytes."""
    try:
        text = data.decode()
    except UnicodeDecodeError as e:
        raise JsonError(f"invalid UTF-8 at byte {e.start}") from None
    if data.count(b"{") + data.count(b"[") > DEPTH and _depth(text) > DEPTH:
        raise JsonError("recursion limit exceeded")
    try:
        value = (_wide if "-0" in text and _MINUS_ZERO.search(text) else _plain)(text)
    except JsonError:
        raise
    except json.JSONDecodeError as e:
        raise JsonError(f"{e.msg} at column {e.pos + 1}") from None
    except (ValueError, RecursionError) as e:
        raise JsonError(str(e)) from None
    if "\\u" in text and _SURROGATE.search(text):
        _no_surrogates(value)
    return value


def _depth(text: str) -> int:
    deep = most = 0
    quoted = escaped = False
    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            deep += 1
            most = max(most, deep)
        elif c in "}]":
            deep -= 1
    return most


def _no_surrogates(value: Any) -> None:
    if isinstance(value, str):
        try:
            value.encode()
        except UnicodeEncodeError:
            raise JsonError("lone surrogate in a string") from None
    elif isinstance(value, dict):
        for k, v in value.items():
            _no_surrogates(k)
            _no_surrogates(v)
    elif isinstance(value, list):
        for v in value:
            _no_surrogates(v)


_dump = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode
_dump_in_order = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_EXPONENT = re.compile(r"(e)\+?(-?)0*(\d)")


def wide(value: int) -> bool:
    """Whether an integer is beyond 64 bits, and so counts as a float."""
    return not I64[0] <= value <= U64[1]


def _numbers(value: Any) -> bool:
    """Whether a value holds numbers that need another notation than Python's."""
    if isinstance(value, float):
        return "e" in repr(value)
    if isinstance(value, int):
        return wide(value)
    if isinstance(value, dict):
        return any(map(_numbers, value.values()))
    return isinstance(value, list) and any(map(_numbers, value))


def _written(value: Any, sort: bool) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_dump(k)}:{_written(v, sort)}" for k, v in (sorted(value.items()) if sort else value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_written(v, sort) for v in value) + "]"
    if isinstance(value, int) and wide(value):
        value = float(value)
    return _EXPONENT.sub(r"\1\2\3", repr(value)) if isinstance(value, float) else _dump(value)


def dumps(value: Any, *, sort: bool = True) -> str:
    """Compact JSON. Keys are in code point order, which is UTF-8's; exponents have no plus sign or leading zeros."""
    return _written(value, sort) if _numbers(value) else (_dump if sort else _dump_in_order)(value)
