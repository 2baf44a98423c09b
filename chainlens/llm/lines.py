"""Line dedup by sharded minimal perfect hashes.

A line's key is the line without the white space [\\x20\\x09-\\x0D] at its ends, A-Z in lower case. Keys of min_chars code
points or more that min_docs documents or more hold lose all their lines, except in the largest id holding them.

One pass hashes the keys of each document (128 bits) and counts documents and the largest id by key, with partial counts
before the shuffle, so that a line in every document is no hot key. The keys that reach min_docs go to shards by hash; a
shard becomes one row: a minimal perfect hash (levels of bit arrays) and, at each key's index, a 64-bit fingerprint, the
count and the largest id. Documents then probe these arrays for the hashes of their lines; lines themselves never move.
The arrays (about 21 bytes a repeated line) are broadcast if their measured size is INDEX_BYTES at most. Beyond it each
shard is one row that stays where it is, and the hashes of the documents' lines are dealt to shards in packed rows: a task
reads a shard's arrays, then probes them for the rows dealt to it, one shard in memory at a time. A shard that many lines
ask for has PARTS such tasks. Only the hashes found go back to their documents, by id and a hash of the text.

Defined cases: a text that is null or empty is one empty line; a line of white space has an empty key; each row counts as
a document, so rows sharing an id count each, and all rows of the largest id keep the line; rows whose id is null count,
and lose the lines; an empty table stays empty; other columns stay as they are, and where one has the name of a result,
the result's name gets underscores at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, dropped, free_name, give_back, make_room, mix, pieces, stored

MIN_CHARS, MIN_DOCS, SHARD_KEYS, INDEX_BYTES, PARTS = 40, 5, 200_000, 64 << 20, 8
_SPACE = b" \t\n\x0b\x0c\r"
_NONE = np.iinfo(np.int64).min


def _seeded(h: np.ndarray, level: int) -> np.ndarray:
    return mix(h + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level, keys alone in their place take it; the others go on."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 1.6) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
            size = max(2, int(len(left) * room))
            at = (_seeded(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, if it is one of those built from; else any index, or -1."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = base + (_seeded(keys[todo], level) % np.uint64(size)).astype(np.int64)
            here = self.bits[at]
            out[todo[here]] = self.rank[at[here]]
            todo, base = todo[~here], base + size
        return out


def keys_of(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """The lines, and the keys' 128-bit digests; b"" for keys that are too short."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    digests = []
    for line in lines:
        digest = b""
        if len(line) >= min_chars:
            key = line.strip(_SPACE).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                digest = xxhash.xxh3_128_digest(key)
        digests.append(digest)
    return lines, digests


def _hashed(docs: DataFrame, min_chars: int, text: str, by: str) -> DataFrame:
    """(h, f, id): a row for each different long key of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for part in pieces(batch):
                ids, found = [], []
                for i, t in zip(column(part, "i").to_pylist(), column(part, "t").to_pylist(), strict=True):
                    own = set(keys_of(t, min_chars)[1])
                    own.discard(b"")
                    found.extend(own)
                    ids.extend([_NONE if i is None else i] * len(own))
                both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(ids, pa.int64())], ["h", "f", "id"])
        give_back()

    return docs.select(F.col(by).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, "h long, f long, id long")


def line_counts(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(h, f, n, last): both halves of the digest of each key that min_docs rows or more hold, their number, the largest id."""
    return _hashed(docs, min_chars, text, by).groupBy("h", "f").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row for each shard that has keys: the perfect hash and the arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        shard, h, f, n, last = (t[c].to_numpy() for c in ("shard", "h", "f", "n", "last"))
        for s in np.unique(shard):
            at = shard == s
            # the hash is of both halves, so that keys that agree in one are told apart
            k = mix(h[at].view(np.uint64)) ^ f[at].view(np.uint64)
            ph = PerfectHash.build(k)
            order = np.empty(len(k), np.int64)
            order[ph.index(k)] = np.arange(len(k))
            cols = [pa.array([int(s)], pa.int32()), pa.array([ph.sizes], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (np.packbits(ph.bits), f[at][order], n[at][order].astype(np.uint32), last[at][order]))]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "sizes", "bits", "marks", "counts", "lasts"])

    dealt = counts.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return dealt.mapInArrow(run, "shard int, sizes array<long>, bits binary, marks binary, counts binary, lasts binary")


class Index:
    """The shards as they are probed."""

    def __init__(self, rows: list[tuple], shards: int):
        self.shards, self.parts = shards, {}
        for shard, sizes, bits, marks, counts, lasts in rows:
            ph = PerfectHash(list(sizes), np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool))
            self.parts[shard] = ph, np.frombuffer(marks, np.int64), np.frombuffer(counts, np.uint32), np.frombuffer(lasts, np.int64)

    def probe(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count and largest id of each digest; count 0 if the index doesn't have it."""
        n, last = np.zeros(len(h), np.uint32), np.full(len(h), _NONE)
        shard = h % self.shards  # as pmod: numpy's remainder has the divisor's sign
        key = mix(h.view(np.uint64)) ^ f.view(np.uint64)
        for s in np.unique(shard):
            if s in self.parts:
                ph, marks, counts, lasts = self.parts[s]
                at = np.flatnonzero(shard == s)
                i = ph.index(key[at])
                ok = (i >= 0) & (marks[i] == f[at])
                n[at[ok]], last[at[ok]] = counts[i[ok]], lasts[i[ok]]
        return n, last


def _cut(docs: DataFrame, drops, min_chars: int, text: str, lines: str, cut: str) -> DataFrame:
    """docs with text cut and two counts of these names; drops(part, digests of each row) tells for each row which lines go."""
    schema = T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(cut, T.LongType())])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for part in pieces(batch):
                split = [keys_of(t, min_chars) for t in column(part, text).to_pylist()]
                gone = drops(part, [d for _, d in split])
                kept, n, lost = [], [], []
                for (own, _), g in zip(split, gone, strict=True):
                    n.append(len(own))
                    k = sum(g) if g is not None else 0
                    lost.append(k)
                    kept.append((b"\n".join(compress(own, [not x for x in g])) if k else b"\n".join(own)).decode("utf-8", "surrogatepass"))
                cols = [pa.array(kept, pa.string()) if c == text else column(part, c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], [*names, lines, cut])
        give_back()

    return docs.mapInArrow(run, schema)


def _asked(docs: DataFrame, min_chars: int, shards: int, text: str, by: str) -> DataFrame:
    """(shard, part, digests, ids, marks): the long keys of each slice of docs, by shard, with their documents' ids and texts' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                ids, marks, found = [], [], []
                for i, m, t in zip(column(piece, "i").to_pylist(), column(piece, "m").to_pylist(), column(piece, "t").to_pylist(), strict=True):
                    own = set(keys_of(t, min_chars)[1])
                    own.discard(b"")
                    found.extend(own)
                    ids.extend([_NONE if i is None else i] * len(own))
                    marks.extend([m] * len(own))
                both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                ids, marks, shard = np.array(ids, np.int64), np.array(marks, np.int64), both[:, 0] % shards
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
                rows = [order[a:b] for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
                cols = [pa.array([int(shard[r[0]]) for r in rows], pa.int32()), pa.array([int(marks[r[0]]) % PARTS for r in rows], pa.int32()), *(pa.array([x[r].tobytes() for r in rows], pa.binary()) for x in (both, ids, marks))]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "part", "digests", "ids", "marks"])
        give_back()

    return docs.select(F.col(by).cast("long").alias("i"), _mark(text).alias("m"), F.col(text).alias("t")).mapInArrow(run, "shard int, part int, digests binary, ids binary, marks binary")


def _mark(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _lost(docs: DataFrame, index: DataFrame, min_chars: int, shards: int, text: str, by: str) -> DataFrame:
    """(id, mark, h, f): the digests of the lines that the row of docs with this id and text loses, by probing the shards where they are."""
    asked = _asked(docs, min_chars, shards, text, by)
    arrays = ("sizes", "bits", "marks", "counts", "lasts")
    none = lambda like, names: [F.lit(None).cast(like.schema[n].dataType).alias(n) for n in names]
    at = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(0).alias("kind"), F.struct(*arrays).alias("index"), F.lit(None).cast("binary").alias("digests"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("texts"))
    ask = asked.select("shard", "part", F.lit(1).alias("kind"), *none(at, ["index"]), "digests", "ids", F.col("marks").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Index | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: column(batch, c)[r].as_py()  # noqa: B023, E731
                if get("kind") == 0:
                    x = get("index")
                    held = Index([(get("shard"), *(x[n] for n in arrays))], shards)
                    continue
                if held is None or get("shard") not in held.parts:
                    continue
                both, ids, texts = np.frombuffer(get("digests"), np.int64).reshape(-1, 2), np.frombuffer(get("ids"), np.int64), np.frombuffer(get("texts"), np.int64)
                n, last = held.probe(both[:, 0].copy(), both[:, 1].copy())
                hit = (n > 0) & ((last != ids) | (ids == _NONE))
                yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (ids, texts, both[:, 0], both[:, 1])], ["id", "mark", "h", "f"])
        give_back()

    return at.unionByName(ask).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(run, "id long, mark long, h long, f long").distinct()


def deduplicated(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index_bytes: int = INDEX_BYTES, text: str = "text", by: str = "doc_id", out: str = "n_") -> DataFrame:
    """docs with the repeated lines cut from text (null becomes empty), and two more columns: lines before, and lines dropped."""
    spark = docs.sparkSession
    names = [free_name(f"{out}{x}", docs.columns) for x in ("lines", "dropped")]
    counts = stored(line_counts(docs, min_chars=min_chars, min_docs=min_docs, text=text, by=by), "lines")
    keys = counts.count()
    shards = max(1, -(-keys // SHARD_KEYS))
    if keys * 22 <= index_bytes:
        rows = [tuple(r) for r in build_index(counts, shards).collect()]
        dropped(counts)
        shared, made = spark.sparkContext.broadcast((rows, shards)), []

        def drops(part: pa.RecordBatch, digests: list[list[bytes]]) -> list[list[bool] | None]:
            if not made:
                made.append(Index(*shared.value))
            sizes = [len(d) for d in digests]
            flat = [x for d in digests for x in d]
            long = np.array([bool(x) for x in flat], bool)
            both = np.frombuffer(b"".join(flat), np.int64).reshape(-1, 2)
            n, last = made[0].probe(both[:, 0].copy(), both[:, 1].copy())
            ids = np.repeat(np.array([_NONE if i is None else i for i in column(part, by).to_pylist()], np.int64), sizes)
            go = np.zeros(len(flat), bool)
            go[long] = (n >= min_docs) & ((last != ids[long]) | (ids[long] == _NONE))
            ends = np.cumsum(sizes)
            any_ = np.add.reduceat(go, ends - sizes) if len(ends) else []
            return [go[e - s : e].tolist() if a else None for a, s, e in zip(any_, sizes, ends, strict=True)]

        return _cut(docs, drops, min_chars, text, *names)
    index = stored(build_index(counts, shards), "index")
    dropped(counts)
    # rows of one id and one text lose the same lines, no more than one text has
    lost = _lost(docs, index, min_chars, shards, text, by).groupBy("id", "mark").agg(F.collect_list(F.struct("h", "f")).alias("lost"))
    name, own_id, own_mark = (free_name(x, docs.columns) for x in ("lost", "lost_id", "lost_mark"))
    wide = docs.join(lost.select(F.col("id").alias(own_id), F.col("mark").alias(own_mark), F.col("lost").alias(name)), (F.coalesce(F.col(by).cast("long"), F.lit(_NONE)) == F.col(own_id)) & (_mark(text) == F.col(own_mark)), "left").drop(own_id, own_mark)

    def listed(part: pa.RecordBatch, digests: list[list[bytes]]) -> list[list[bool] | None]:
        result = []
        for d, lose in zip(digests, column(part, name).to_pylist(), strict=True):
            gone = {np.array([x["h"], x["f"]], np.int64).tobytes() for x in lose or ()}
            result.append([x in gone for x in d] if gone else None)
        return result

    return _cut(wide, listed, min_chars, text, *names).drop(name)
