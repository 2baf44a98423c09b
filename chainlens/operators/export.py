"""Exports of a log's records by time: JSON lines, CSV or syslog, with a manifest of digests.

A first pass digests the log: the roots over all records and over the kept ones, and whether every line is a record. Only
then are the kept records decoded again and written, in the log's order, to part files in a folder beside the target; these
are put together and renamed, after the manifest, so that no export stands without one.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blake3, messages, record, text
from ..functions.wire import VALUES
from ..sources import segments
from . import digest as dg
from . import splits
from .digest import NONE, Checks
from .inspect import checked
from .records import Reader, records
from .root import chain_root

# Fixed value: marks a manifest among records.
KIND = VALUES["export_manifest_kind"]
FORMATS = ("jsonl", "csv", "syslog")
FACILITY = 16


class ExportError(ValueError):
    pass


@dataclass
class Manifest:
    """Fields are in the order of its JSON."""

    kind: str
    exported_count: int
    source_chain_root: str
    filtered_export_digest: str
    # the bounds as they were given
    from_: str | None
    to: str | None

    def as_dict(self) -> dict[str, object]:
        return {k.rstrip("_"): v for k, v in asdict(self).items()}


def bound(given: str | None) -> int | None:
    if given is None:
        return None
    try:
        return record.ns_of_rfc3339(given)
    except ValueError as e:
        raise ExportError(messages.BAD_FILTER.format(given=json.dumps(given), details=e)) from None


class _JsonLines(Reader):
    def __init__(self, keeps, proofs: bool):
        super().__init__(unicode_blank=True)
        self.keeps, self.proofs = keeps, proofs

    def feed(self, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = [(i, r) for i, r, _ in self.records(lines) if r and self.keeps(r.timestamp_ns)]
        hashes = blake3.hexes(blake3.hash_many([record.entry_message(r) for _, r in rows])) if self.proofs else [None] * len(rows)
        n = len(rows)
        cols = [pa.array([self.name] * n, pa.string()), pa.array([self.block] * n, pa.int64()), pa.array([i for i, _ in rows], pa.int64()), pa.array([record.to_json(r, h) for (_, r), h in zip(rows, hashes, strict=True)], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["name", "block", "line", "text"])


def lines_of(scan: DataFrame, form: str, checks: Checks, proofs: bool, facility: int, app: str = text.APP) -> DataFrame:
    """(name, block, line, text) of the kept records."""
    keeps = checks.keeps
    if form == "jsonl":
        return splits.split_map(scan, lambda: _JsonLines(keeps, proofs), "name string, block long, line long, text string")
    rows = records(scan, hashes=proofs and form == "csv", keep=lambda r: keeps(r.timestamp_ns)).where("problem IS NULL")
    c = F.col
    if form == "csv":
        shown = text.csv_line(sequence=c("sequence"), timestamp_ns=c("timestamp_ns"), event_type=c("event_type"), source=c("source"), payload_hash=c("payload_hash"), prev_hash=c("prev_hash"), signed=c("signature").isNotNull(), entry_hash=c("entry_hash") if proofs else None)
    else:
        shown = text.syslog_line(facility, app=app, sequence=c("sequence"), timestamp_ns=c("timestamp_ns"), event_type=c("event_type"), source=c("source"), payload_hash=c("payload_hash"))
    return rows.select("name", "block", "line", shown.alias("text"))


def in_order(lines: DataFrame) -> DataFrame:
    """Sorted into ranges by place in the log; what isn't exported isn't moved."""
    return lines.orderBy("name", "block", "line").select("text")


class Export:
    """An export whose manifest is known and whose lines can be written anywhere."""

    def __init__(self, spark: SparkSession, directory: str, form: str = "jsonl", *, from_: str | None = None, to: str | None = None, proofs: bool = False, facility: int = FACILITY, app: str = text.APP):
        if form not in FORMATS:
            raise ExportError(f"an export's format is one of {', '.join(FORMATS)}, not {form}")
        if not 0 <= facility <= 23:
            raise ExportError(messages.BAD_FACILITY.format(given=facility))
        checks = Checks(policy=NONE, unicode_blank=True, from_ns=bound(from_), to_ns=bound(to))
        if checks.from_ns is not None and checks.to_ns is not None and checks.from_ns > checks.to_ns:
            raise ExportError(messages.INVERTED_RANGE.format(from_=json.dumps(from_), to=json.dumps(to)))
        self.spark, self.form = spark, form
        found = segments.list_segments(spark, directory)
        scan = segments.scan_segments(spark, found)
        digest = dg.digest(scan, checks)
        try:
            checked(digest, found)
            count, kept = digest.totals["records"], digest.totals["kept"]
            source = chain_root(digest.runs().select("start", "hashes"), count)
            filtered = source if kept == count else chain_root(digest.kept_runs(), kept)
        finally:
            digest.release()
        self.manifest = Manifest(KIND, kept, source, filtered, from_, to)
        self.lines = in_order(lines_of(scan, form, checks, proofs, facility, app))

    def inline(self) -> str | None:
        """The manifest as a last line, which only JSON lines have room for."""
        return json.dumps(self.manifest.as_dict(), ensure_ascii=False, separators=(",", ":")) if self.form == "jsonl" else None

    def __iter__(self) -> Iterator[str]:
        """The lines, fetched one partition at a time."""
        for r in self.lines.toLocalIterator():
            yield r["text"]
        if (last := self.inline()) is not None:
            yield last

    def write(self, target: str) -> str:
        """Writes target and its manifest on any file system that Spark reads; returns the manifest's path."""
        spark = self.spark
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        mark = f".tmp.{os.getpid()}.{uuid.uuid4().hex[:8]}"
        parts, joined, sidecar = f"{target}{mark}.parts", f"{target}{mark}", f"{target}.manifest.json"
        fs = path(target).getFileSystem(conf)
        try:
            self.lines.write.option("lineSep", "\n").text(parts)
            out = fs.create(path(joined), True)
            try:
                for s in sorted((s.getPath().getName(), s.getPath()) for s in fs.listStatus(path(parts)) if s.getPath().getName().startswith("part-")):
                    part = fs.open(s[1])
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                    finally:
                        part.close()
                if (last := self.inline()) is not None:
                    out.write(bytearray((last + "\n").encode()))
            finally:
                out.close()
            _put(fs, path, sidecar, mark, json.dumps(self.manifest.as_dict(), ensure_ascii=False, indent=2).encode())
            _rename(fs, path(joined), path(target))
        finally:
            fs.delete(path(parts), True)
            fs.delete(path(joined), False)
        return sidecar


def _rename(fs, old, new) -> None:
    """Puts old in the place of new, which is there before and after: readers find the one or the other."""
    if fs.getUri().getScheme() == "file":
        os.replace(old.toUri().getPath(), new.toUri().getPath())
        for p in (old, new):  # checksums of what was there
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{os.path.dirname(p.toUri().getPath())}/.{p.getName()}.crc")
        return
    hadoop = SparkSession.active()._jvm.org.apache.hadoop.fs
    options = SparkSession.active()._sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(old), fs.makeQualified(new), options)


def _put(fs, path, target: str, mark: str, data: bytes) -> None:
    out = fs.create(path(f"{target}{mark}"), True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    _rename(fs, path(f"{target}{mark}"), path(target))
