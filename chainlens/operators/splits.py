"""Work on scans, one file block at a time, in order, in the task that reads it; and the places of blocks in the whole log.

A block is read by one task, line after line. So what compares a record with the one before needs nothing but the state of
that task, except for a block's first record; that one is checked against the end of the block before, from a table with one
row a block. Positions work the same way: within the block by counting, between blocks by sums over that table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A table with a row a block is broadcast up to this many rows, some tens of MB; beyond it blocks are joined by a shuffle.
BROADCAST_ROWS = 300_000


class Worker(Protocol):
    """Gets the blocks of a task one after another."""

    def open(self, name: str, block: int) -> None: ...

    def feed(self, lines: list[bytes]) -> Iterator[pa.RecordBatch]: ...

    def close(self) -> Iterator[pa.RecordBatch]: ...


def split_map(scan: DataFrame, make: Callable[[], Worker], schema: str) -> DataFrame:
    """What the workers give for the blocks of a scan (line, name, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, at = make(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, name, block = batch.column(0), batch.column(1), batch.column(2)
            last = batch.num_rows - 1
            moved = pc.or_(pc.not_equal(name[1:], name[:last]), pc.not_equal(block[1:], block[:last])) if last else None
            edges = [0, *(np.flatnonzero(moved.to_numpy(zero_copy_only=False)) + 1).tolist(), last + 1] if last else [0, 1]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                here = name[lo].as_py(), block[lo].as_py()
                if here != at:
                    if at is not None:
                        yield from worker.close()
                    worker.open(*here)
                    at = here
                yield from worker.feed(lines[lo:hi].to_pylist())
        if at is not None:
            yield from worker.close()

    return scan.select("line", "name", "block").mapInArrow(run, schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has few rows, which were counted."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def placed(blocks: DataFrame, counts: tuple[str, ...] = ("lines", "records")) -> DataFrame:
    """blocks (name, block, counts, tail) with each one's place in the log.

    New: for each of counts what comes before the block (line_at, record_at, ...); name_line_at, the lines before it in its
    segment; before, the tail of the last block that had records. Blocks of a segment meet in a task; the segments' table has
    a row a file, as the listing of the directory has.
    """
    inside = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    place = {c: f"{c[:-1] if c.endswith('s') else c}_at" for c in counts}
    own = blocks.select("*", *[running(c, inside).alias(f"inside_{c}") for c in counts], F.last("tail", ignorenulls=True).over(inside).alias("inside_tail"))
    segments = blocks.groupBy("name").agg(*[F.sum(c).alias(c) for c in counts], F.expr("max_by(tail, block) FILTER (WHERE tail IS NOT NULL)").alias("tail"))
    segments = segments.select("name", *[running(c, ahead).alias(f"ahead_{c}") for c in counts], F.last("tail", ignorenulls=True).over(ahead).alias("ahead_tail"))
    met = own.join(segments, "name")
    return met.select(*blocks.columns, *[(F.col(f"ahead_{c}") + F.col(f"inside_{c}")).alias(place[c]) for c in counts], F.col("inside_lines").alias("name_line_at"), F.coalesce("inside_tail", "ahead_tail").alias("before"))
