"""Segment directories: enumeration, guards, and the scan of lines in place.

A row of a scan is a line with the name of its segment and the start of the file block that it was read from. The lines of
a block come in order and in one task; blocks are ordered by (name, block). Nothing is sorted or shuffled for that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages

# What counts as a segment.
EXTENSIONS = ("wal", "jsonl")
SIDECARS = ("batch_ledger.jsonl",)

SCAN = "line binary, name string, block long"


class SegmentError(ValueError):
    """The directory can't be read as a log."""


@dataclass(frozen=True)
class Segment:
    name: str
    path: str
    size: int


def sortable(names: list[str]) -> str | None:
    """What is wrong with sorting these names as text: stems of digits alone that differ in width."""
    stems = [s for n in names if (s := n.rsplit(".", 1)[0]) and all("0" <= c <= "9" for c in s)]
    for s in stems[1:]:
        if len(s) != len(stems[0]):
            a, b = (x.replace("\\", "\\\\").replace('"', '\\"') for x in (stems[0], s))
            return messages.UNSORTABLE_PAIR.format(a=a, wa=len(stems[0]), b=b, wb=len(s))
    return None


def select_segments(names: list[str]) -> list[str]:
    """The names of segments among those of a directory's files, in order; SegmentError if they can't be ordered, or not be read."""
    own = sorted((n for n in names if "." in n.lstrip(".") and n.rsplit(".", 1)[1] in EXTENSIONS and n not in SIDECARS), key=str.encode)
    if offender := sortable(own):
        raise SegmentError(messages.UNSORTABLE.format(offender=offender))
    for n in own:
        if n[0] in "._":
            raise SegmentError(f"Segment {n!r} would be passed over by Spark, which skips files whose names begin with . or _; rename it")
    return own


def list_segments(spark: SparkSession, directory: str) -> list[Segment]:
    """The segments of a directory on any file system that Spark reads, in order."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(directory)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top) or not fs.getFileStatus(top).isDirectory():
        raise SegmentError(messages.NOT_A_DIRECTORY.format(path=directory))
    found = {s.getPath().getName(): s for s in fs.listStatus(top) if s.isFile()}
    return [Segment(n, found[n].getPath().toString(), found[n].getLen()) for n in select_segments(list(found))]


def _literal(path: str) -> str:
    """A path without meaning to Spark's globs."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def lines_of(reader) -> DataFrame:
    """The scan of a text reader's frame."""
    return reader.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"))


def scan_segments(spark: SparkSession, segments: list[Segment]) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], SCAN)
    # only \n ends a line, so that a \r stays with it
    return lines_of(spark.read.option("lineSep", "\n").text([_literal(s.path) for s in segments]))


def scan_directory(spark: SparkSession, directory: str) -> DataFrame:
    return scan_segments(spark, list_segments(spark, directory))


def scan_bytes(spark: SparkSession, data: bytes, parts: int = 1) -> DataFrame:
    """The lines of bytes, as if they were a segment of parts blocks."""
    lines = data.split(b"\n")
    step = max(1, -(-len(lines) // parts))
    rows = [(bytearray(x), "bytes", i // step) for i, x in enumerate(lines)]
    frame = spark.createDataFrame(rows, SCAN)
    # a block must lie in one task, in order
    return frame.coalesce(1)


def total_size(segments: list[Segment]) -> int:
    return min(2**64 - 1, sum(s.size for s in segments))
