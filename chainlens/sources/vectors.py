"""Files of test vectors: one JSON object with a section for each primitive, read as a frame a section."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import strict_json
from .keystore import read_bytes

SCHEMA_VERSION = 1
_TEXTS = ("prev_hash", "payload_hash", "event_type", "source", "signature", "public_key")
_ENTRY = "sequence decimal(20,0), timestamp_ns long, " + ", ".join(f"{f} string" for f in _TEXTS)
_RECEIPT = "event_id string, payload_hash string, server_time string, server_seq decimal(20,0), receipt_sig string, server_key_id string, sig_alg string, batch_id string"
#: The sections, and the fields of their cases. Inputs of canonical_json are JSON text here.
SECTIONS = {
    "canonical_json": "name string, input string, expected_canonical_json_utf8 string, expected_payload_hash_blake3 string",
    "entry_hash": f"name string, input struct<{_ENTRY}>, expected_entry_hash string",
    "sign_hash": f"name string, input struct<{_ENTRY}>, expected_sign_hash string",
    "chain_root": f"name string, inputs array<struct<{_ENTRY}>>, expected_entry_hashes array<string>, expected_root string",
    "receipt_canonical_message": f"name string, input struct<{_RECEIPT}>, expected_canonical_message_hex string, expected_canonical_message_utf8 string",
    "signature": f"name string, profile string, input struct<{_ENTRY}>, signing_key_seed_hex string, public_key_hex string, signed_message_hex string, signature_hex string",
}


class VectorError(ValueError):
    pass


def _row(section: str, case: dict[str, Any]) -> dict[str, Any]:
    def typed(value: dict[str, Any]) -> dict[str, Any]:
        whole = {f: str(value[f]) for f in ("sequence", "server_seq") if f in value}
        return value | whole

    out = dict(case)
    if section == "canonical_json":
        out["input"] = strict_json.dumps(case["input"], sort=False)
    elif "inputs" in case:
        out["inputs"] = [typed(x) for x in case["inputs"]]
    else:
        out["input"] = typed(case["input"])
    return out


def parse(spark: SparkSession, data: bytes) -> dict[str, DataFrame]:
    """The sections' frames. VectorError if the file isn't of this schema or lacks a section; a section may be empty."""
    try:
        value = strict_json.parse(data)
    except strict_json.JsonError as e:
        raise VectorError(f"the vectors are not JSON: {e}") from None
    if not isinstance(value, dict) or value.get("schema_version") != SCHEMA_VERSION:
        raise VectorError(f"the vectors' schema_version must be {SCHEMA_VERSION}")
    if missing := [s for s in SECTIONS if s not in value]:
        raise VectorError(f"the vectors lack {', '.join(missing)}")
    out = {}
    for section, schema in SECTIONS.items():
        lines = [strict_json.dumps(_row(section, c), sort=False) for c in value[section]["cases"]]
        from_json = spark.createDataFrame([(x,) for x in lines], "line string").selectExpr(f"from_json(line, '{schema}') AS c")
        out[section] = from_json.select("c.*")
    return out


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse(spark, read_bytes(spark, path))
