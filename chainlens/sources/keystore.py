"""Keystores: the servers' keys by id, from JSON files or pairs."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions import ed25519, messages, strict_json
from ..functions.wire import VALUES

# Fixed value of the file format.
SCHEMA = VALUES["keystore_schema"]


class KeystoreError(ValueError):
    def __init__(self, path: str, details: str):
        super().__init__(messages.KEYSTORE_LOAD.format(path=path, details=details))


class Keystore(Mapping[str, bytes]):
    """Keys of 32 bytes by id. It doesn't change, and is small: it travels with the tasks that use it."""

    def __init__(self, keys: Mapping[str, bytes]):
        self._keys = dict(sorted(keys.items()))

    @classmethod
    def from_keys(cls, pairs: Iterable[tuple[str, bytes]]) -> Keystore:
        return cls(dict(pairs))

    @classmethod
    def from_json(cls, data: bytes, path: str = "<bytes>") -> Keystore:
        try:
            value = strict_json.parse(data)
        except strict_json.JsonError as e:
            raise KeystoreError(path, f"invalid JSON: {e}") from None
        keys = value.get("keys") if isinstance(value, dict) else None
        if not isinstance(keys, dict) or not isinstance(value.get("schema"), str) or not all(isinstance(v, str) for v in keys.values()):
            raise KeystoreError(path, "invalid JSON: an object with schema and keys (texts by id) is expected")
        if value["schema"] != SCHEMA:
            raise KeystoreError(path, f"unsupported keystore schema {json.dumps(value['schema'])} (expected {SCHEMA})")
        out = {}
        for name, text in sorted(keys.items()):
            try:
                raw = bytes.fromhex(text) if text.isascii() and text.isalnum() or not text else None
            except ValueError:
                raw = None
            if raw is None:
                raise KeystoreError(path, f"pubkey for {name} is not valid hex: {text!r}")
            if len(raw) != 32:
                raise KeystoreError(path, f"pubkey for {name} must be 32 bytes, got {len(raw)}")
            if ed25519.decompress(raw) is None:
                raise KeystoreError(path, f"pubkey for {name} is not a valid Ed25519 point: it cannot be decompressed")
            out[name] = raw
        return cls(out)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Keystore:
        """From a file on any file system that Spark reads."""
        return cls.from_json(read_bytes(spark, path), path)

    def __getitem__(self, key_id: str) -> bytes:
        return self._keys[key_id]

    def __iter__(self):
        return iter(self._keys)

    def __len__(self) -> int:
        return len(self._keys)

    def is_empty(self) -> bool:
        return not self._keys

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, v.hex()) for k, v in self._keys.items()], "key_id string, public_key string")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes, through Hadoop's file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    except Exception as e:
        raise KeystoreError(path, str(getattr(e, "java_exception", e)).split("\n")[0]) from None
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
