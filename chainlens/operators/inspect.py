"""Statistics, lookups and the last events of a log, without a verdict. A line that is no record ends each of them with an error."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages, record, text
from ..functions.record import Record
from ..functions.strict_json import parse
from ..sources import segments
from . import digest as dg
from . import splits
from .digest import NONE, Checks, Digest
from .records import Reader


class LogReadError(ValueError):
    """A line of the log can't be read."""

    def __init__(self, path: str, line: int, details: str, utf8: bool = False):
        super().__init__(messages.READ_ERROR.format(path=path, details=details) if utf8 else messages.RECORD_ERROR.format(path=path, line=line, details=details))


def path_of(found: list[segments.Segment], name: str) -> str:
    return next((s.path.removeprefix("file:") for s in found if s.name == name), name)


def checked(digest: Digest, found: list[segments.Segment]) -> None:
    """LogReadError for the first line that is no record."""
    if not digest.totals["errors"]:
        return
    from ..plans.lenient import errors_of

    first = errors_of(digest).where(F.col("rank") == dg.PARSE).orderBy("line").first()
    if first is not None:
        raise LogReadError(path_of(found, first["name"]), first["name_line"] + 1, first["details"].split(": ", 1)[-1] if first["error_type"] == "parse_error" else first["details"], first["error_type"] == "invalid_utf8")


def stats_frame(digest: Digest) -> DataFrame:
    """One row of statistics; flags are null where the log has no records."""
    head, before, tail = F.col("head"), F.col("before"), F.col("tail")
    u64 = lambda c: c.cast("decimal(20,0)")
    expected = F.least(u64(before["sequence"]).cast("decimal(21,0)") + 1, F.lit(str(record.U64[1])).cast("decimal(21,0)"))
    seam = {
        "chain_break": F.coalesce(before["hash"], F.lit(record.GENESIS_PREV_HASH)) == head["hash"],
        "sequence_gap": F.when(before.isNull(), u64(head["sequence"]) == 1).otherwise(u64(head["sequence"]) == expected),
        "timestamp_regression": before.isNull() | (head["ts"] >= before["ts"]),
    }
    inside = digest.parts.groupBy("name", "block").agg(*[F.bool_and(F.expr(f"NOT exists(errors, e -> e.error_type = '{kind}')")).alias(kind) for kind in seam])
    met = digest.blocks.where("records > 0").join(splits.small(inside, digest.n_blocks), ["name", "block"])
    return met.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_events"),
        F.min_by(head["sequence"], "record_at").alias("first_sequence"),
        F.max_by(tail["sequence"], "record_at").alias("last_sequence"),
        F.min_by(head["ts"], "record_at").alias("first_timestamp_ns"),
        F.max_by(tail["ts"], "record_at").alias("last_timestamp_ns"),
        (F.coalesce(F.sum("signed"), F.lit(0)) > 0).alias("has_signatures"),
        F.bool_and(seam["chain_break"] & F.col("chain_break")).alias("prev_hash_links_ok"),
        F.bool_and(seam["sequence_gap"] & F.col("sequence_gap")).alias("sequence_contiguous"),
        F.bool_and(seam["timestamp_regression"] & F.col("timestamp_regression")).alias("timestamps_monotonic"),
        (F.sum("signed") == F.sum("records")).alias("all_signed"),
        F.coalesce(F.sum("with_receipt"), F.lit(0)).alias("events_with_receipt"),
        (F.coalesce(F.sum("records"), F.lit(0)) - F.coalesce(F.sum("with_receipt"), F.lit(0))).alias("events_without_receipt"),
        (F.coalesce(F.sum("sdk"), F.lit(0)) > 0).alias("is_sdk_format"),
    )


def stats(spark: SparkSession, directory: str) -> dict[str, Any]:
    found = segments.list_segments(spark, directory)
    digest = dg.digest(segments.scan_segments(spark, found), Checks(policy=NONE, unicode_blank=True))
    try:
        checked(digest, found)
        s = stats_frame(digest).first()
        streams = sorted((r["s"] for r in digest.parts.select(F.explode("streams").alias("s")).distinct().collect()), key=str.encode) if digest.totals["sdk"] else []
    finally:
        digest.release()
    none = lambda x: None if x is None else int(x)
    return {
        "segment_count": len(found),
        "total_events": s["total_events"],
        "first_sequence": none(s["first_sequence"]),
        "last_sequence": none(s["last_sequence"]),
        "first_timestamp_ns": s["first_timestamp_ns"],
        "last_timestamp_ns": s["last_timestamp_ns"],
        "total_size_bytes": segments.total_size(found),
        "has_signatures": s["has_signatures"],
        "integrity": {k: bool(s[k]) for k in ("prev_hash_links_ok", "sequence_contiguous", "timestamps_monotonic", "all_signed")},
        "stream_ids": streams,
        "events_with_receipt": s["events_with_receipt"],
        "events_without_receipt": s["events_without_receipt"],
        "is_sdk_format": s["is_sdk_format"],
    }


_FOUND = "name string, block long, line long, kind string, body string"


class _Picker(Reader):
    """Some records of each block, and the first line that is none."""

    def __init__(self):
        super().__init__(unicode_blank=True)

    def open(self, name: str, block: int) -> None:
        super().open(name, block)
        self.bad: tuple[int, str] | None = None

    def row(self, line: int, kind: str, body: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((self.name, self.block, line, kind, body), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["name", "block", "line", "kind", "body"])

    def feed(self, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        for i, r, problem in self.records(lines):
            if r is not None:
                self.see(i, r)
            elif self.bad is None:
                self.bad = i, problem or ""
        return iter(())

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.bad:
            yield self.row(self.bad[0], "bad", self.bad[1])
        yield self.row(self.line, "lines", "")
        for i, kind, r in self.picked():
            yield self.row(i, kind, record.to_line(r))

    def see(self, line: int, r: Record) -> None:
        raise NotImplementedError

    def picked(self) -> list[tuple[int, str, Record]]:
        raise NotImplementedError


class _Sequence(_Picker):
    """The first record of a sequence, and the first of a greater one."""

    def __init__(self, sequence: int):
        super().__init__()
        self.sequence = sequence

    def open(self, name: str, block: int) -> None:
        super().open(name, block)
        self.hit: tuple[int, str, Record] | None = None

    def see(self, line: int, r: Record) -> None:
        if self.hit is None and r.sequence >= self.sequence:
            self.hit = line, "equal" if r.sequence == self.sequence else "greater", r

    def picked(self) -> list[tuple[int, str, Record]]:
        return [self.hit] if self.hit else []


class _Last(_Picker):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def open(self, name: str, block: int) -> None:
        super().open(name, block)
        self.kept: deque[tuple[int, str, Record]] = deque(maxlen=self.n)

    def see(self, line: int, r: Record) -> None:
        self.kept.append((line, "record", r))

    def picked(self) -> list[tuple[int, str, Record]]:
        return list(self.kept)


def _raise_bad(rows: DataFrame, found: list[segments.Segment]) -> None:
    bad = rows.where("kind = 'bad'").orderBy("name", "block", "line").first()
    if bad is not None:
        before = rows.where((F.col("kind") == "lines") & (F.col("name") == bad["name"]) & (F.col("block") < bad["block"])).agg(F.sum("line")).first()[0] or 0
        raise LogReadError(path_of(found, bad["name"]), before + bad["line"] + 1, bad["body"])


def _rows(spark: SparkSession, directory: str, make) -> tuple[DataFrame, list[segments.Segment]]:
    found = segments.list_segments(spark, directory)
    return splits.split_map(segments.scan_segments(spark, found), make, _FOUND).persist(), found


def find_event(spark: SparkSession, directory: str, sequence: int) -> dict[str, Any] | None:
    """The first record of that sequence; None if a greater sequence comes before it."""
    rows, found = _rows(spark, directory, lambda: _Sequence(sequence))
    try:
        _raise_bad(rows, found)
        hit = rows.where("kind IN ('equal', 'greater')").orderBy("name", "block", "line").first()
    finally:
        rows.unpersist()
    return parse(hit["body"].encode()) if hit is not None and hit["kind"] == "equal" else None


def display(records: DataFrame) -> DataFrame:
    """How records are shown: nine columns."""
    c = F.col
    return records.select("sequence", text.rfc3339(c("timestamp_ns")).alias("timestamp"), F.coalesce("event_type", F.lit("-")).alias("event_type"), F.coalesce("source", F.lit("-")).alias("source"), text.short_hash(c("payload_hash")).alias("payload_hash_short"), text.short_hash(c("prev_hash")).alias("prev_hash_short"), c("signature").isNotNull().alias("signed"), "event_id", c("receipt").isNotNull().alias("has_receipt"))


def last_events(spark: SparkSession, directory: str, n: int = 10) -> list[dict[str, Any]]:
    """The last n records in log order, as they are shown. Blocks give their own last n at most."""
    if n <= 0:
        return []
    rows, found = _rows(spark, directory, lambda: _Last(n))
    try:
        _raise_bad(rows, found)
        last = rows.where("kind = 'record'").orderBy(F.desc("name"), F.desc("block"), F.desc("line")).limit(n).collect()
    finally:
        rows.unpersist()
    out = []
    for r in sorted(last, key=lambda r: (r["name"].encode(), r["block"], r["line"])):
        e = parse(r["body"].encode())
        short = lambda h: h if len(h) <= 16 else h[:16] + "..."
        or_dash = lambda x: "-" if x is None else x
        out.append({"sequence": e["sequence"], "timestamp": rfc3339(e["timestamp_ns"]), "event_type": or_dash(e["event_type"]), "source": or_dash(e["source"]), "payload_hash_short": short(e["payload_hash"]), "prev_hash_short": short(e["prev_hash"]), "signed": e["signature"] is not None, "event_id": e["event_id"], "has_receipt": e["receipt"] is not None})
    return out


def rfc3339(ns: int) -> str:
    """As text.rfc3339(), of one number."""
    seconds, rest = divmod(ns, 10**9)
    nine = f"{rest:09d}"
    fraction = "" if not rest else "." + (nine[:3] if rest % 10**6 == 0 else nine[:6] if rest % 1000 == 0 else nine)
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S") + fraction + "+00:00"


def events_table(events: list[dict[str, Any]]) -> str:
    out = ["", f"{'SEQ':>8} | {'TIMESTAMP':^24} | {'EVENT_TYPE':^20} | {'PAYLOAD_HASH':^16} | {'SIGNED':^6}", "-" * 86]
    out += [f"{e['sequence']:>8} | {e['timestamp'][:24]:^24} | {e['event_type'][:20]:^20} | {e['payload_hash_short']:^16} | {'yes' if e['signed'] else 'no':^6}" for e in events]
    return "\n".join(out)

