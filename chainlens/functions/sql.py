"""The scalar functions that Spark lacks, for SQL: register(spark) makes them known to a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blake3, canonical, ed25519, record
from .record import Record


def _bytes(x: object) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)  # type: ignore[call-overload]


def _map(values: pd.Series, fn) -> pd.Series:
    return pd.Series([None if v is None else fn(v) for v in values], dtype=object)


@F.pandas_udf(T.StringType())
def blake3_hex(data: pd.Series) -> pd.Series:
    """The BLAKE3 of bytes."""
    known = [None if x is None else _bytes(x) for x in data]
    found = iter(blake3.hexes(blake3.hash_many([x for x in known if x is not None])))
    return pd.Series([None if x is None else next(found) for x in known], dtype=object)


def _canonical(text: str) -> tuple[str | None, str | None]:
    try:
        return canonical.canonical_json_from_bytes(text.encode("utf-8", "surrogatepass")).decode(), None
    except canonical.CanonicalError as e:
        return None, e.kind


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of JSON text; null if it has none."""
    return _map(text, lambda t: _canonical(t)[0])


@F.pandas_udf(T.StringType())
def canonical_error(text: pd.Series) -> pd.Series:
    """Why JSON text has no canonical form; null if it has one."""
    return _map(text, lambda t: _canonical(t)[1])


@F.pandas_udf(T.StringType())
def payload_hash(text: pd.Series) -> pd.Series:
    """The BLAKE3 of the canonical form of JSON text."""
    forms = [None if t is None else _canonical(t)[0] for t in text]
    found = iter(blake3.hexes(blake3.hash_many([f.encode() for f in forms if f is not None])))
    return pd.Series([None if f is None else next(found) for f in forms], dtype=object)


def _hashes(message, seq: pd.Series, ts: pd.Series, *texts: pd.Series) -> pd.Series:
    names = ("prev_hash", "payload_hash", "event_type", "source", "signature", "public_key")
    none = lambda v: None if v is None or v != v else v
    rows = [Record(sequence=int(s), timestamp_ns=int(t), **dict(zip(names, map(none, own), strict=False))) for s, t, *own in zip(seq, ts, *texts, strict=True)]
    return pd.Series(blake3.hexes(blake3.hash_many([message(r) for r in rows])), dtype=object)


@F.pandas_udf(T.StringType())
def entry_hash(sequence: pd.Series, timestamp_ns: pd.Series, prev_hash: pd.Series, payload_hash: pd.Series, event_type: pd.Series, source: pd.Series, signature: pd.Series, public_key: pd.Series) -> pd.Series:
    return _hashes(record.entry_message, sequence, timestamp_ns, prev_hash, payload_hash, event_type, source, signature, public_key)


@F.pandas_udf(T.StringType())
def sign_hash(sequence: pd.Series, timestamp_ns: pd.Series, prev_hash: pd.Series, payload_hash: pd.Series, event_type: pd.Series, source: pd.Series) -> pd.Series:
    return _hashes(record.sign_message, sequence, timestamp_ns, prev_hash, payload_hash, event_type, source)


@F.pandas_udf(T.BooleanType())
def ed25519_verify(public_key: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    """Whether a signature (hex) of a message (bytes) verifies under a key (hex)."""
    key = [record.unhex(k or "", 32) or b"" for k in public_key]
    sig = [record.unhex(s or "", 64) or b"" for s in signature]
    return pd.Series(ed25519.verify_many(key, [_bytes(m if m is not None else b"") for m in message], sig))


@F.pandas_udf(T.StringType())
def receipt_message_hex(event_id: pd.Series, payload_hash: pd.Series, server_time: pd.Series, server_seq: pd.Series, server_key_id: pd.Series, sig_alg: pd.Series, batch_id: pd.Series) -> pd.Series:
    """The bytes that a receipt's signature is of, in hex."""
    names = ("event_id", "payload_hash", "server_time", "server_seq", "server_key_id", "sig_alg", "batch_id")
    return pd.Series([record.receipt_message(dict(zip(names, r, strict=True)) | {"server_seq": int(r[3])}).hex() for r in zip(event_id, payload_hash, server_time, server_seq, server_key_id, sig_alg, batch_id, strict=True)], dtype=object)


FUNCTIONS = {"blake3_hex": blake3_hex, "canonical_json": canonical_json, "canonical_error": canonical_error, "payload_hash": payload_hash, "entry_hash": entry_hash, "sign_hash": sign_hash, "ed25519_verify": ed25519_verify, "receipt_message_hex": receipt_message_hex}


def register(spark: SparkSession) -> None:
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
