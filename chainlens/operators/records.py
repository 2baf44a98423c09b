"""Records as rows: the log's lines decoded into columns, for any query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blake3, record
from ..functions.record import Record
from ..functions.strict_json import JsonError, dumps
from ..sources import segments
from . import splits
from .digest import ASCII_BLANK

RECEIPT = "event_id string, payload_hash string, server_time string, server_seq long, receipt_sig string, server_key_id string, sig_alg string, batch_id string"
#: name, block and line say where a record stands; line counts from 0 in the block. problem: why a line is none.
RECORDS = f"name string, block long, line long, format_version long, sequence string, timestamp_ns long, prev_hash string, payload_hash string, event_type string, source string, signature string, public_key string, key_id string, event_id string, stream_id string, hash_alg string, payload string, receipt struct<{RECEIPT}>, entry_hash string, problem string"
_P_RECEIPT = pa.struct([(f, pa.int64() if f == "server_seq" else pa.string()) for f in record.RECEIPT_FIELDS])


class Reader:
    """Lines to records, one after another."""

    def __init__(self, iso: bool = True, unicode_blank: bool = False):
        self.iso, self.unicode_blank = iso, unicode_blank

    def open(self, name: str, block: int) -> None:
        self.name, self.block, self.line = name, block, 0

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def records(self, lines: list[bytes]) -> Iterator[tuple[int, Record | None, str | None]]:
        """(line, record, problem) of every line that isn't blank."""
        begin, self.line = self.line, self.line + len(lines)
        for i, line in enumerate(lines, begin):
            line = line[:-1] if line[-1:] == b"\r" else line
            if not line.strip(ASCII_BLANK):
                continue
            try:
                if self.unicode_blank and not line.decode("utf-8", "replace").strip():
                    continue
                yield i, record.decode(line, iso=self.iso), None
            except JsonError as e:
                yield i, None, str(e)


class Rows(Reader):
    def __init__(self, iso: bool, keep: Callable[[Record], bool] | None = None, hashes: bool = False):
        super().__init__(iso)
        self.keep, self.hashes = keep, hashes

    def feed(self, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = [x for x in self.records(lines) if x[1] is None or self.keep is None or self.keep(x[1])]
        n = len(rows)
        get = lambda f: [getattr(r, f) if r else None for _, r, _ in rows]
        cols: dict[str, Any] = {"name": pa.array([self.name] * n, pa.string()), "block": pa.array([self.block] * n, pa.int64()), "line": pa.array([i for i, _, _ in rows], pa.int64())}
        for f in record.FIELDS:
            values = get(f)
            if f in ("format_version", "timestamp_ns"):
                cols[f] = pa.array(values, pa.int64())
            elif f == "sequence":
                cols[f] = pa.array([None if v is None else str(v) for v in values], pa.string())
            elif f == "payload":
                cols[f] = pa.array([None if v is None else dumps(v, sort=False) for v in values], pa.string())
            elif f == "receipt":
                cols[f] = pa.array(values, _P_RECEIPT)
            else:
                cols[f] = pa.array(values, pa.string())
        known = [r for _, r, _ in rows if r] if self.hashes else []
        hashes = iter(blake3.hexes(blake3.hash_many([record.entry_message(r) for r in known])))
        cols["entry_hash"] = pa.array([next(hashes) if r and self.hashes else None for _, r, _ in rows], pa.string())
        cols["problem"] = pa.array([p for _, _, p in rows], pa.string())
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def records(scan: DataFrame, *, iso: bool = True, hashes: bool = False, keep: Callable[[Record], bool] | None = None) -> DataFrame:
    """The records of a scan; a line that is none has its problem, and no fields. Filter what can be filtered on lines or segments before."""
    out = splits.split_map(scan, lambda: Rows(iso, keep, hashes), RECORDS)
    return out.withColumn("sequence", F.col("sequence").cast("decimal(20,0)"))


def read_log(spark: SparkSession, directory: str, *, iso: bool = True, hashes: bool = False) -> DataFrame:
    return records(segments.scan_directory(spark, directory), iso=iso, hashes=hashes)
