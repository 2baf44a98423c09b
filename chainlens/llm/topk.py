"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Components become integers, floor(scale * x). Vectors lie in blocks of BLOCK; in a block every dimension has its list of
vectors sorted by that component, built once and stored. A query reads the lists from their better ends (the top if its
component is positive, the bottom if negative) and scores what it sees in full. The bound at a depth is the sum over
dimensions of the query's component times the one last read: no unseen vector has more. So the depth that is needed is
known from the k-th score so far: the least one whose bound is below it; at equality the query reads on, as an unseen tie
could have the smaller id. Once the parts of lists to be read are together as long as the block, the block is scored as a
whole by one matrix product, since reading on would touch as many entries: over many even dimensions that is what happens.

A task holds up to QUERY_BLOCK queries and has GROUP blocks of candidates pass, keeping each query's k best: the k-th score
is carried from block to block, and only k rows a query leave the task. Blocks of queries meet groups of blocks by key, so
neither side is collected or broadcast; candidates move once for each QUERY_BLOCK queries.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do null ids; shorter vectors
count as if filled up with zeros; an empty vector scores 0 with all; rows that repeat an id are candidates each, but no
row of the query's own id is; queries that repeat an id share their k best; equal scores rank by smaller id; an empty table
gives no rows. Components whose scaled value, or scores that, do not fit a long raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, give_back, stored

K, SCALE, BLOCK, QUERY_BLOCK, GROUP, FIRST, LANES = 5, 256, 4096, 16_384, 64, 16, 256
_NEVER = np.iinfo(np.int64).min


class Lists:
    """A block of vectors with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.v = (ids, vectors) if order is not None else (ids[by_id], vectors[by_id])
        # best first for positive components
        self.order = np.argsort(-self.v, axis=0, kind="stable") if order is None else order
        self.most = int(np.abs(self.v).max(initial=0))

    def product(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Inner products of each row of q with each of v, exact."""
        most = self.most * int(np.abs(q).max(initial=0)) * max(1, q.shape[1])
        if most < 1 << 53:
            return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
        if most < 1 << 62:
            return q @ v.T
        out = q.astype(object) @ v.T.astype(object)
        if out.size and max(map(abs, out.ravel())) >= 1 << 63:
            raise ValueError("scores of these vectors don't fit a long")
        return out.astype(np.int64)

    def depths(self) -> np.ndarray:
        n = len(self.ids)
        return np.unique(np.minimum(n, FIRST << np.arange(max(1, int(n / FIRST + 1).bit_length() + 1))))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(depths, queries): what no vector unseen at that depth has more than."""
        n, at = len(self.ids), self.depths() - 1
        top, low = np.take_along_axis(self.v, self.order[at], 0), np.take_along_axis(self.v, self.order[n - 1 - at], 0)
        return self.product(np.maximum(q, 0), top).T + self.product(np.minimum(q, 0), low).T

    def best(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The number of the query, id and score of what may be among each query's k best, and how many vectors were scored. What is below floor is left out.

        q: queries as rows, own: their ids, floor: what the k-th score is known to reach.
        """
        n, found, scored = len(self.ids), [], 0
        if not n or not len(q):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        depths, bounds, active = self.depths(), self.bounds(q), (q != 0).sum(1)
        whole = []
        for x in range(len(q)):
            kth, seen = floor[x], None
            while True:
                need = int(np.argmax(bounds[:, x] < kth)) if (bounds[:, x] < kth).any() else len(depths) - 1
                if kth == _NEVER:
                    need = 0
                depth = int(depths[need])
                if depth * int(active[x]) >= n or not active[x]:
                    whole.append(x)
                    break
                up, down = np.flatnonzero(q[x] > 0), np.flatnonzero(q[x] < 0)
                seen = np.unique(np.concatenate((self.order[:depth, up].ravel(), self.order[n - depth :, down].ravel())))
                seen = seen[self.ids[seen] != own[x]]
                score = self.product(q[x : x + 1], self.v[seen])[0]
                if len(seen) >= k:
                    kth = max(kth, int(np.partition(score, -k)[-k]))
                if bounds[need, x] < kth:
                    ok = score >= floor[x]
                    found.append((np.full(int(ok.sum()), x), self.ids[seen[ok]], score[ok]))
                    scored += len(seen)
                    break
                if kth == _NEVER or not (bounds[:, x] < kth).any():  # fewer than k were seen, or reading on never ends early
                    whole.append(x)
                    break
        for lo in range(0, len(whole), LANES):
            part = np.array(whole[lo : lo + LANES])
            score = self.product(q[part], self.v)
            scored += score.size
            begin, end = np.searchsorted(self.ids, own[part], "left"), np.searchsorted(self.ids, own[part], "right")
            for r in np.flatnonzero(end > begin):
                score[r, begin[r] : end[r]] = _NEVER
            kth = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(part), _NEVER)
            row, at = np.nonzero((score >= np.maximum(kth, floor[part])[:, None]) & (score != _NEVER))
            found.append((part[row], self.ids[at], score[row, at]))
        return (*(np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in range(3)), scored)


def ranked(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by query, falling score, id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def usable(table: DataFrame, *, vector: str = "embedding", by: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def scaled(x):
        y = F.floor(x.cast("double") * F.lit(scale))
        return F.when(F.abs(x.cast("double") * F.lit(scale)) < F.lit(2.0**63), y.cast("long")).otherwise(F.raise_error(F.lit("a component doesn't fit a long")).cast("long"))

    return table.where(F.col(by).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(by).cast("long").alias("id"), F.transform(F.col(vector), scaled).alias("v"))


def _blocks(vectors: DataFrame, rows: int, lists: bool) -> tuple[DataFrame, int]:
    """(block, ids, v, lists, dims): the vectors of each block in one row, in order of their ids, with sorted lists if asked for; and the number of blocks.

    Blocks are ranges of a hash of id and vector, so rows that repeat an id are spread, unless they are equal.
    """
    blocks = max(1, -(-vectors.count() // rows))

    def pack(group: pa.Table) -> pa.Table:
        block, ids, v = group["block"][0].as_py(), group["id"].to_numpy(), group["v"].combine_chunks()
        sizes = np.diff(v.offsets.to_numpy())
        m = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
        m[np.arange(m.shape[1]) < sizes[:, None]] = v.flatten().to_numpy()
        made = []
        for lo in range(0, len(ids), 2 * rows):  # equal rows meet in one block, which then is cut
            part = Lists(ids[lo : lo + 2 * rows], m[lo : lo + 2 * rows])
            made.append((block, part.ids.tobytes(), part.v.tobytes(), part.order.astype(np.uint16).tobytes() if lists else b"", m.shape[1]))
        return pa.table({c: [x[i] for x in made] for i, c in enumerate(("block", "ids", "v", "lists", "dims"))}, pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("v", pa.binary()), ("lists", pa.binary()), ("dims", pa.int32())]))

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(11)), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, v binary, lists binary, dims int"), blocks


class _Held:
    """A block of queries, with the best of each so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.best = (np.zeros(0, np.int64),) * 3
        self.floor = np.full(len(ids), _NEVER)
        self.scored = 0

    def meet(self, lists: Lists) -> None:
        size = max(self.q.shape[1], lists.v.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, size - m.shape[1])))
        if lists.v.shape[1] < size:
            lists = Lists(lists.ids, wide(lists.v))
        *new, scored = lists.best(wide(self.q), self.ids, self.k, self.floor)
        self.scored += scored
        self.best = ranked(*(np.concatenate(x) for x in zip(self.best, new, strict=True)), self.k)
        query, _, score = self.best
        n = np.bincount(query, minlength=len(self.ids))
        last = np.cumsum(n) - 1
        full = n >= self.k
        self.floor[full] = score[last[full]]


def search(queries: DataFrame, candidates: DataFrame, k: int = K, *, scored: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) of usable() vectors: the k best candidates of each query. scored: (query_id, vectors scored for its block) instead."""
    packed, n_cand = _blocks(candidates, BLOCK, True)
    cand = stored(packed, "lists")
    ask, n_ask = _blocks(queries, QUERY_BLOCK, False)
    groups = -(-n_cand // GROUP)
    none = F.lit(None).cast("binary")
    left = ask.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(0).alias("kind"), "ids", "v", none.alias("lists"), "dims")
    right = cand.select(F.explode(F.sequence(F.lit(0), F.lit(n_ask - 1))).alias("block"), F.pmod(F.col("block"), F.lit(groups)).alias("g"), F.lit(1).alias("kind"), "ids", "v", "lists", "dims")
    kind = "query_id long, scored long" if scored else "query_id long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Held] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            for h in held:
                if scored:
                    yield pa.RecordBatch.from_arrays([pa.array(h.ids[:1]), pa.array([h.scored] * len(h.ids[:1]), pa.int64())], ["query_id", "scored"])
                else:
                    query, ids, score = h.best
                    yield pa.RecordBatch.from_arrays([pa.array(h.ids[query]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: column(batch, c)[r].as_py()  # noqa: B023, E731
                if key != (at := (get("block"), get("g"))):
                    yield from done()
                    held, key = [], at
                ids, dims = np.frombuffer(get("ids"), np.int64), get("dims")
                v = np.frombuffer(get("v"), np.int64).reshape(len(ids), dims)
                if get("kind") == 0:
                    held.append(_Held(ids, v, k))
                elif held:
                    lists = Lists(ids, v, np.frombuffer(get("lists"), np.uint16).reshape(len(ids), dims))
                    for h in held:
                        h.meet(lists)
        yield from done()
        give_back()

    met = left.unionByName(right).repartition("block", "g").sortWithinPartitions("block", "g", "kind").mapInArrow(run, kind)
    if scored:
        return met
    # k rows a query and group of blocks are left
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(table: DataFrame, every: int = 50, k: int = K, *, vector: str = "embedding", by: str = "vec_id", scale: int = SCALE, scored: bool = False) -> DataFrame:
    """search() with the rows whose id every divides as the queries, all rows as candidates."""
    all_ = usable(table, vector=vector, by=by, scale=scale)
    return search(all_.where(F.pmod(F.col("id"), F.lit(every)) == 0), all_, k, scored=scored)
