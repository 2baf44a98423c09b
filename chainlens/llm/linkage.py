"""Groups of like texts, by banded sketches: candidates, verification and connected components, all distributed.

Equal texts are one class, and only a class's first document is sketched further. Texts that share a band key meet in a
bucket. No bucket emits all its pairs: in each round every member is compared with one leader of its bucket, and only if
the two are not in one component yet. A large group of near copies so costs a comparison or two a member. The first two
leaders are a bucket's least id and its largest, so a bucket of two members is done after a round, and one of three after
two; few are larger. After ROUNDS rounds, those that are, and still hold several components, are settled in place, first
by sketches alone: a task gets the sketches of a block of a bucket, or of two, and tells which members have a partner there that may be near. Only those
members' texts move, and a task emits only the links that join components, so never more than its members. Nothing is
capped: pairs that share a bucket are all looked at, but for those whose sketches rule them out.

Comparisons go from cheap to dear: sizes, then sketches, then the shingles of the two texts. A pair is ruled out by its
sketches if fewer entries agree than least_agreeing() says, which a pair at the threshold has with odds of ODDS at most.
What is looked up by bucket is broadcast if small; else rows are dealt by bucket and one of SALTS salts, so that a
bucket of any size is spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, dropped, give_back, make_room, mix, pieces, shingle_hashes, small, stored, texts_of

ROUNDS, ODDS, SALTS = 2, 1e-9, 16
#: Members and words of a block of a bucket that is settled in one task; larger buckets have several blocks, and a task for each two of them.
BLOCK_ROWS, BLOCK_WORDS = 1024, 1_000_000
#: Links (16 bytes each) that one task joins to components; more are joined by rounds of jobs, each of which costs the driver memory.
LINKS = 1 << 20
#: Bytes of texts that are sketched at a time; an executor's memory holds a worker of each core beside its heap.
SKETCHED = 512 << 10

#: texts -> band keys (uint64), sketch (uint8), size, each with one row a text
Sketch = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of consecutive entries of each signature; the band's number is part of it."""
    n, k = sig.shape
    rows = k // bands
    part = sig[:, : bands * rows].reshape(n, bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bands)).copy()
    for j in range(rows):
        out = mix(out ^ part[:, :, j] * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


@cache
def least_agreeing(entries: int, threshold: float) -> int:
    """The largest k so that fewer than k of a sketch's entries agree with odds of ODDS at most, if the likeness is the threshold."""
    if not 0 < threshold < 1:
        return 0 if threshold <= 0 else entries
    below = 0.0
    for k in range(entries + 1):
        below += exp(lgamma(entries + 1) - lgamma(k + 1) - lgamma(entries - k + 1) + k * log(threshold) + (entries - k) * log(1 - threshold))
        if below > ODDS:
            return k
    return entries


def by_bucket(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """rows (k, id, ...) with the columns of found, which has a row for each of n buckets k; others go."""
    few = small(found, n)
    if few is not found:
        return rows.join(few, "k")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, ["k", "salt"]).drop("salt")


def least_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids in links (a, b), and the least id of the component of each: larger roots go under smaller ones until no link has two."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        x, y = root[x], root[y]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return ids, ids[root]


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, root) of all ids in links (a, b): root is the least id of the component.

    Up to LINKS of them are joined by one task. Of more, labels spread to neighbours, then jump to their label's label, in rounds of jobs.
    """
    links = links.select("a", "b")
    if links.count() <= LINKS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [(column(x, "a").to_numpy(), column(x, "b").to_numpy()) for x in batches if x.num_rows]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in least_ids(*map(np.concatenate, zip(*found, strict=True)))], ["id", "root"])
            give_back()

        return stored(links.repartition(1).mapInArrow(run, "id long, root long"), "labels")
    edges = stored(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        spread = edges.join(labels, edges["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        joined = labels.join(spread, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        hop = labels.select(F.col("id").alias("root"), F.col("root").alias("up"))
        after = stored(joined.join(hop, "root").select("id", F.least("root", "up").alias("root"), (F.least("root", "up") < F.col("was")).alias("moved")), "labels")
        moved = not after.where("moved").isEmpty()
        dropped(labels)
        labels = after.select("id", "root")
        labels._chainlens_path = after._chainlens_path
        if not moved:
            dropped(edges)
            return labels


def sketch_batches(batches: Iterator[pa.RecordBatch], sketch: Sketch) -> Iterator[pa.RecordBatch]:
    """Rows (id, digest, keys, marks, size) of batches (i, d, t), SKETCHED bytes at a time."""
    for batch in batches:
        for part in pieces(batch, SKETCHED):
            texts = texts_of(part, "t")
            keys, marks, size = sketch(texts)
            flat = pa.array(np.ascontiguousarray(keys).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1]), flat)
            raw, step = np.ascontiguousarray(marks).tobytes(), marks.shape[1]
            yield pa.RecordBatch.from_arrays([column(part, "i"), column(part, "d"), lists, pa.array([raw[k * step : k * step + step] for k in range(len(texts))], pa.binary()), pa.array(size, pa.int64())], ["id", "digest", "keys", "marks", "size"])


def _sketched(docs: DataFrame, sketch: Sketch, text: str, by: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        yield from sketch_batches(batches, sketch)
        give_back()

    return docs.select(F.col(by).cast("long").alias("i"), _digest(text).alias("d"), F.col(text).alias("t")).mapInArrow(run, "id long, digest binary, keys array<long>, marks binary, size long")


def _digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b, ma, mb) that their sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ma, mb = (np.frombuffer(b"".join(column(batch, x).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for x in ("ma", "mb"))
                yield batch.select(["a", "b"]).filter(pa.array((ma == mb).sum(1) >= least_agreeing(ma.shape[1], threshold)))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, likeness: Callable[[np.ndarray, np.ndarray], float], threshold: float, width: int) -> DataFrame:
    """(a, b, near) of pairs (a, b, ta, tb); one text is cut into shingles once for rows in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                a, b, near = column(part, "a").to_pylist(), column(part, "b").to_pylist(), []
                at: dict[int, int] = {}
                texts: list[str] = []
                for ids, ts in ((a, texts_of(part, "ta")), (b, texts_of(part, "tb"))):
                    for i, t in zip(ids, ts, strict=True):
                        if i not in at:
                            at[i] = len(texts)
                            texts.append(t)
                hashes, begin = shingle_hashes(texts, width)
                of = lambda i: hashes[begin[at[i]] : begin[at[i] + 1]]  # noqa: B023, E731
                near = [likeness(of(x), of(y)) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([x >= threshold for x in near], pa.bool_())], ["a", "b", "near"])
        give_back()

    return pairs.mapInArrow(run, "a long, b long, near boolean")


def groups(docs: DataFrame, sketch: Sketch, likeness: Callable[[np.ndarray, np.ndarray], float], threshold: float, *, width: int = 5, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(by, class_id, group_id) of every row of docs that has an id: the least ids of the rows of equal text, and of the texts linked to it."""
    spark = docs.sparkSession
    slim = stored(_sketched(docs.where(F.col(by).isNotNull()), sketch, text, by), "sketches")
    owners, times = docs.where(F.col(by).isNotNull()).select(F.col(by).cast("long").alias("id"), F.col(text).alias("t")), None
    if not slim.groupBy("id").count().where("count > 1").isEmpty():
        # rows that share an id are one document, with the text of the least digest: whatever task runs again finds the same
        times = stored(slim.groupBy("id").agg(F.min("digest").alias("digest"), F.count("*").cast("int").alias("times")), "owners")
        slim = stored(slim.join(times.drop("times"), ["id", "digest"]).dropDuplicates(["id"]), "sketches")
        owners = owners.withColumn("digest", _digest("t")).join(times, ["id", "digest"]).select("id", "t").dropDuplicates(["id"])
    # any value of keys, marks and size will do, as equal texts have equal ones; only ids are compared
    classes = slim.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = stored(classes.where("n > 1").select("digest", "rep"), "copies")
    n_copies = copies.count()
    labelled = slim.join(small(copies, n_copies), "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"), "keys", "marks", "size")
    reps = labelled.where("id = rep").select("id", "keys", "marks", "size")
    keys = reps.where("size > 0").select("id", "size", F.explode("keys").alias("k"))
    # a bucket counts if two different ids meet in it; min and max tell, with partial sums before the shuffle
    met = stored(keys.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("k"), "buckets")
    members = stored(by_bucket(keys, met, met.count()).select("k", "id", "size").distinct(), "members")
    dropped(met)
    ids = stored(members.select("id").distinct(), "ids")
    n_ids = ids.count()
    links = None
    if n_ids:
        cand = stored(owners.join(small(ids, n_ids), "id"), "texts")
        marks = stored(reps.join(small(ids, n_ids), "id").select("id", "keys", "marks"), "marks")
        links = _links(spark, members, cand, marks, likeness, threshold, width)
        dropped(cand)
        dropped(marks)
    out = labelled.select("id", "rep")
    if links is None:
        out = out.withColumn("root", F.col("rep"))
    else:
        roots = components(spark, links)
        out = out.join(small(roots.select(F.col("id").alias("rep"), "root"), roots.count()), "rep", "left").select("id", "rep", F.coalesce("root", "rep").alias("root"))
    if times is not None:
        out = out.join(times.select("id", F.explode(F.sequence(F.lit(1), F.col("times")))), "id")
    return out.select(F.col("id").alias(by), F.col("rep").alias("class_id"), F.col("root").alias("group_id"))


def _links(spark: SparkSession, members: DataFrame, cand: DataFrame, marks: DataFrame, likeness, threshold: float, width: int) -> DataFrame | None:
    """(a, b) links that join all texts which share a bucket and are as like as the threshold; not all such pairs, if fewer do."""
    links: DataFrame | None = None
    live, tested = members.withColumn("root", F.col("id")), None
    for round_ in range(ROUNDS):
        # the least id, the largest, then any
        order, pick = F.xxhash64("id", F.lit(round_)) if round_ > 1 else F.col("id"), F.max if round_ == 1 else F.min
        lead = stored(live.groupBy("k").agg(pick(F.struct(order.alias("o"), "id", "size", "root")).alias("l")).select("k", F.col("l.id").alias("lid"), F.col("l.size").alias("lsize"), F.col("l.root").alias("lroot")), "leaders")
        met = by_bucket(live, lead, lead.count()).where(F.col("root") != F.col("lroot")).where(F.least("size", "lsize") >= F.greatest("size", "lsize") * F.lit(threshold))
        pairs = met.select(F.least("id", "lid").alias("a"), F.greatest("id", "lid").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        sketched = pairs.join(marks.select(F.col("id").alias("a"), F.col("marks").alias("ma")), "a").join(marks.select(F.col("id").alias("b"), F.col("marks").alias("mb")), "b").select("a", "b", "ma", "mb")
        like = stored(_alike(sketched, threshold), "alike")
        dropped(lead)
        if not like.isEmpty():
            wide = like.join(cand.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(cand.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")
            done = stored(_verified(wide, likeness, threshold, width), "verified")
            new = done.where("near").select("a", "b")
            links = new if links is None else links.union(new)
            tested = done.select("a", "b") if tested is None else tested.union(done.select("a", "b"))
        dropped(like)
        # what remains: buckets that hold two components or more, and members of which no leader was one
        now = members.select("k", "id", "size")
        if links is not None:
            roots = components(spark, links)
            now = now.join(small(roots, roots.count()), "id", "left").select("k", "id", "size", F.coalesce("root", "id").alias("root"))
        else:
            now = now.withColumn("root", F.col("id"))
        split = stored(now.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("words")).where(F.col("lo") < F.col("hi")).where(F.col("n") > min(round_ + 2, 3)).select("k", "n", "words"), "split")
        n_split = split.count()
        if not n_split:
            return links
        live = stored(by_bucket(now, split.select("k"), n_split), "live")
    last = stored(_settled(live, split, n_split, cand, marks, likeness, threshold, width), "settled")
    return last if links is None else links.union(last)


class _Block:
    """A block of a bucket, or two blocks of one, with the pairs in it that sizes and sketches don't rule out.

    A pair that shares several buckets is looked at in that of its first band only; with two blocks, only pairs across count.
    """

    def __init__(self, group: pa.Table, threshold: float):
        k, i, j = (group[c][0].as_py() for c in ("k", "i", "j"))
        group = group.sort_by("id")
        self.group, self.apart = group, i != j
        self.ids, self.size, self.own, self.root = (group[c].to_numpy() for c in ("id", "size", "own", "root"))
        n = len(self.ids)
        self.sketch = np.frombuffer(b"".join(group["marks"].to_pylist()), np.uint8).reshape(n, -1)
        keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        self.keys = keys[:, : int(np.flatnonzero(keys[0] == k)[0])]
        self.threshold, self.least = threshold, least_agreeing(self.sketch.shape[1], threshold)

    def partners(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """The members after x that may be near x, and how many entries of their sketches agree."""
        near = (self.root != self.root[x]) & (np.minimum(self.size, self.size[x]) >= self.threshold * np.maximum(self.size, self.size[x]))
        if self.apart:
            near &= self.own != self.own[x]
        near[: x + 1] = False
        at = np.flatnonzero(near)
        if len(at) and self.keys.shape[1]:
            at = at[~(self.keys[at] == self.keys[x]).any(1)]
        agree = (self.sketch[at] == self.sketch[x]).sum(1)
        return at[agree >= self.least], agree[agree >= self.least]


def _settled(live: DataFrame, split: DataFrame, n_split: int, cand: DataFrame, marks: DataFrame, likeness, threshold: float, width: int) -> DataFrame:
    """(a, b) links that join the components of each bucket as far as they can be joined."""
    shape = split.select("k", F.greatest(F.ceil(F.col("n") / F.lit(BLOCK_ROWS)), F.ceil(F.col("words") / F.lit(BLOCK_WORDS)), F.lit(1)).cast("int").alias("blocks"))
    own = by_bucket(live, shape, n_split).withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    met = own.select("k", "id", "size", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("k", "id", "size", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sketched = met.join(marks, "id").select("k", "i", "j", "own", "id", "size", "root", "keys", "marks")

    def asks(group: pa.Table) -> pa.Table:
        block = _Block(group, threshold)
        asked = np.zeros(len(block.ids), bool)
        for x in range(len(block.ids)):
            at, _ = block.partners(x)
            if len(at):
                asked[x] = asked[at] = True
        return block.group.filter(pa.array(asked)).select(["k", "i", "j", "own", "id", "size", "root"])

    asked = stored(sketched.groupBy("k", "i", "j").applyInArrow(asks, "k long, i int, j int, own int, id long, size long, root long"), "asked")
    wide = asked.join(marks, "id").join(cand, "id").select("k", "i", "j", "own", "id", "size", "root", "keys", "marks", "t")

    def settle(group: pa.Table) -> pa.Table:
        block = _Block(group, threshold)
        found = []
        for x in range(len(block.ids)):
            found += [(-e, x, y) for y, e in zip(*(z.tolist() for z in block.partners(x)), strict=True)]
        found.sort()
        up = {r: r for r in block.root.tolist()}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        texts, cut, a, b = block.group["t"], {}, [], []
        for _, x, y in found:
            rx, ry = top(int(block.root[x])), top(int(block.root[y]))
            if rx != ry:
                for z in (x, y):
                    if z not in cut:
                        cut[z] = shingle_hashes([texts[z].as_py() or ""], width)[0]
                if likeness(cut[x], cut[y]) >= threshold:
                    up[max(rx, ry)] = min(rx, ry)
                    a.append(block.ids[x])
                    b.append(block.ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return wide.groupBy("k", "i", "j").applyInArrow(settle, "a long, b long")
