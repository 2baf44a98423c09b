"""Manifests of published logs: what a host pins, and the gate that its assets must pass before anything is verified."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strict_json
from . import scratch
from .keystore import read_bytes

SCHEMA_VERSION = 1
#: The manifest's field of an asset's digest, by the asset.
DIGESTS = {"wal": "wal_sha256", "wasm": "wasm_sha256", "js": "js_sha256"}


class ManifestError(ValueError):
    pass


@dataclass(frozen=True)
class Manifest:
    fields: dict[str, Any]

    @classmethod
    def from_json(cls, data: bytes) -> Manifest:
        try:
            value = strict_json.parse(data)
        except strict_json.JsonError as e:
            raise ManifestError(f"the manifest is not JSON: {e}") from None
        if not isinstance(value, dict) or value.get("schema_version") != SCHEMA_VERSION:
            raise ManifestError(f"the manifest's schema_version must be {SCHEMA_VERSION}")
        missing = [k for k in ("manifest_version", "expected_public_key", "expected_chain_root", "wal_sha256") if k not in value]
        if missing:
            raise ManifestError(f"the manifest lacks {', '.join(missing)}")
        return cls(value)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Manifest:
        return cls.from_json(read_bytes(spark, path))

    def __getitem__(self, field: str) -> Any:
        return self.fields[field]


def asset_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of files below 2 GB, hashed where they are read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def digest(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file of any size, read as a stream by the driver's JVM."""
    at, fs = scratch.file_system(spark, path)
    jvm = spark._jvm
    sha = jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = jvm.java.security.DigestInputStream(fs.open(at(path)), sha)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), 1 << 16, True)
    return bytes(sha.digest()).hex()


def gate(spark: SparkSession, manifest: Manifest, assets: dict[str, str]) -> None:
    """ManifestError unless the SHA-256 of every asset (wal, wasm or js, by path) is the pinned one."""
    for kind, path in assets.items():
        pinned = manifest.fields.get(DIGESTS[kind])
        found = digest(spark, path)
        if found != pinned:
            raise ManifestError(f"{kind}: the SHA-256 is {found}, the manifest pins {pinned}")
