"""Tables as logs: their rows as records, and sealed into segment directories."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ed25519 import SigningKey
from ..functions.record import Record
from ..functions.strict_json import parse
from ..operators.seal import Sealer, payload_record, seal_lines, seal_table
from . import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns_of(ts: Column) -> Column:
    """Nanoseconds since 1970 of a time without zone, whatever the session's zone is."""
    return (F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) * F.lit(1000)).cast("long")


def events_as_records(events: DataFrame) -> DataFrame:
    """The events table in the columns of records."""
    return events.select((F.col("event_id") + 1).alias("sequence"), ns_of(F.col("ts")).alias("timestamp_ns"), "event_type", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"), F.col("props").alias("payload"))


def payload_records(rows: DataFrame) -> Iterator[Record]:
    """Records of (sequence, timestamp_ns, event_type, source, payload) in order of sequence, fetched a partition at a time."""
    for r in rows.orderBy("sequence").toLocalIterator(prefetchPartitions=True):
        yield payload_record(int(r["sequence"]), r["timestamp_ns"], parse(r["payload"].encode()), event_type=r["event_type"], source=r["source"])


def write_log(spark: SparkSession, rows: Iterable[Record], directory: str, key: SigningKey | None = None, profile: str = "lenient", per_segment: int = 100_000) -> str:
    """Seals rows as one chain into segments of a directory; returns the root. One chain is a loop, so this runs on the driver, in constant memory."""
    at, fs = scratch.file_system(spark, directory)
    fs.mkdirs(at(directory))
    sealer, out, n, held = Sealer(key, profile), None, 0, []
    try:
        for line in seal_lines(rows, sealer):
            if n % per_segment == 0:
                if out is not None:
                    out.write(bytearray("".join(held).encode()))
                    held.clear()
                    out.close()
                out = fs.create(at(f"{directory}/{n // per_segment:08d}.jsonl"), True)
            held.append(line + "\n")
            n += 1
            if len(held) >= 4096 and out is not None:
                out.write(bytearray("".join(held).encode()))
                held.clear()
        if out is not None:
            out.write(bytearray("".join(held).encode()))
    finally:
        if out is not None:
            out.close()
    return sealer.expected_root()


_LOGS: dict[tuple[str, str, str], tuple[str, str]] = {}


def sealed_events(spark: SparkSession, sf_dir: str, seed: bytes | None = None, profile: str = "lenient", per_segment: int = 20_000) -> tuple[str, str]:
    """(directory, root) of the whole events table as one sealed log; made once in a session."""
    made = spark.sparkContext.applicationId, sf_dir, f"{seed!r}{profile}{per_segment}"
    if made not in _LOGS:
        directory = scratch.new_dir(spark, "log")
        root = seal_table(events_as_records(table(spark, sf_dir, "events")), directory, SigningKey(seed) if seed else None, profile, per_segment)
        _LOGS[made] = directory, root
    return _LOGS[made]
