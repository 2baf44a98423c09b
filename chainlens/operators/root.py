"""Chain roots: BLAKE3 over the concatenated hex texts of entry hashes, as a distributed tree reduction.

Sixteen texts of 64 bytes are one chunk of the hash's tree. A row with consecutive entry hashes gives the subtrees that lie
in it whole, and the few hashes at its two ends whose chunks it shares with its neighbours. Subtrees of 2**LIFT chunks are
put together by a shuffle, which a log needs only from some millions of records on; the rest is done on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blake3
from ..functions.blake3 import PER_CHUNK, RAW, Node

LIFT = 18
#: Rows of nodes that the driver takes at once without the shuffle; beyond it there is a row for each 2**LIFT chunks.
DRIVER_NODES = 200_000
_NODES = "level int, number long, place int, data binary"


def row_nodes(start: int, hashes: np.ndarray, count: int | None) -> list[tuple[int, int, int, bytes]]:
    """Of hashes (n x 32) that begin at position start of a list of count: (level, number, 0, chaining value), or (RAW, chunk, place in it, hashes).

    count None: the list may go on, so the first chunk and the list's end stay raw.
    """
    n, out = len(hashes), []
    end = start + n
    head = min(n, -start % PER_CHUNK)
    if count is None and start == 0:
        head = min(n, PER_CHUNK)
    tail = 0 if end == count else end % PER_CHUNK
    if head:
        out.append((RAW, start // PER_CHUNK, start % PER_CHUNK, hashes[:head].tobytes()))
    if tail and n - tail >= head:
        out.append((RAW, end // PER_CHUNK, 0, hashes[n - tail :].tobytes()))
    else:
        tail = 0
    whole = hashes[head : n - tail]
    if len(whole):
        first = (start + head) // PER_CHUNK
        chunks = -(-(count or 1 << 62) // PER_CHUNK)
        if chunks == 1:
            out.append((RAW, 0, 0, whole.tobytes()))
        else:
            nodes = {(0, first + i): cv for i, cv in enumerate(blake3.list_chunks(whole, first))}
            out += [(lv, i, 0, cv.tobytes()) for (lv, i), cv in blake3.lifted(nodes, LIFT, chunks).items()]
    return out


def nodes_of(rows: DataFrame, count: int | None) -> DataFrame:
    """row_nodes() of rows (start long, hashes binary)."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for s, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in row_nodes(s, np.frombuffer(h, np.uint8).reshape(-1, 32), count)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["level", "number", "place", "data"])

    return rows.select("start", "hashes").mapInArrow(reduce_rows, _NODES)


def _gathered(rows: list[tuple[int, int, int, bytes]], count: int) -> tuple[dict[Node, np.ndarray], list[tuple[int, int, int, bytes]]]:
    """The nodes of rows, with chunks put together from their parts; and the parts of chunks that aren't whole yet."""
    chunks = -(-count // PER_CHUNK)
    nodes = {(lv, i): np.frombuffer(b, np.uint32) for lv, i, _, b in rows if lv != RAW}
    parts: dict[int, list[tuple[int, bytes]]] = {}
    for lv, i, place, b in rows:
        if lv == RAW:
            parts.setdefault(i, []).append((place, b))
    rest = []
    for i, own in parts.items():
        data = b"".join(b for _, b in sorted(own))
        if len(data) == 32 * (PER_CHUNK if i < chunks - 1 else count - i * PER_CHUNK):
            nodes[0, i] = blake3.list_chunks(np.frombuffer(data, np.uint8).reshape(-1, 32), i, root=chunks == 1)[0]
        else:
            rest += [(RAW, i, place, b) for place, b in own]
    return nodes, rest


def chain_root(rows: DataFrame, count: int) -> str:
    """The root of rows (start long, hashes binary): runs of entry hashes (32 bytes each) that cover positions 0 to count - 1."""
    if not count:
        return blake3.EMPTY.hex()
    nodes = nodes_of(rows, count)
    if count > DRIVER_NODES * PER_CHUNK * 16:

        def reduce_group(df: pd.DataFrame) -> pd.DataFrame:
            have, rest = _gathered(list(df[["level", "number", "place", "data"]].itertuples(index=False, name=None)), count)
            up = blake3.lifted(have, LIFT, -(-count // PER_CHUNK))
            return pd.DataFrame([*rest, *((lv, i, 0, cv.tobytes()) for (lv, i), cv in up.items())], columns=["level", "number", "place", "data"])

        # a group has the nodes of 2**LIFT chunks: as many rows as its runs of hashes give, whatever the log's size
        group = F.expr(f"shiftright(number, {LIFT} - greatest(level, 0))")
        nodes = nodes.groupBy(group.alias("group")).applyInPandas(reduce_group, _NODES)
    have, rest = _gathered([tuple(r) for r in nodes.collect()], count)
    if rest:
        raise ValueError(f"the rows don't cover positions 0 to {count - 1} once each")
    chunks = -(-count // PER_CHUNK)
    if chunks == 1:
        return have[0, 0].tobytes().hex()
    return blake3.finished(have, chunks).hex()


def chain_root_of(table: DataFrame, order: str, entry_hash: str, rows: int = 8192) -> str:
    """The root of a table's hex entry hashes by a column of consecutive integers."""
    own = F.col(order).cast("long")
    ends = table.agg(F.min(own), F.max(own), F.count("*")).first()
    low, high, count = (x or 0 for x in ends)
    if count and high - low + 1 != count:
        raise ValueError(f"{order} is not consecutive: {count} rows from {low} to {high}")
    place = own - F.lit(low)
    runs = table.select(place.alias("p"), F.unhex(entry_hash).alias("h")).groupBy(F.expr(f"p div {rows}").alias("g")).agg(F.min("p").alias("start"), F.array_sort(F.collect_list(F.struct("p", "h"))).alias("l"))
    return chain_root(runs.select("start", F.expr("unhex(array_join(transform(l, x -> hex(x.h)), ''))").alias("hashes")), count)
