"""Document fingerprints: MinHash signatures over word shingles, and near duplicates found by their bands.

A signature holds, for each of PERMS universal hash functions x -> a*x + b mod 2^64 (a odd), the least value over a
text's shingles of five words, kept as 16 mixed bits. Equal texts have equal fingerprints; the share of equal entries
estimates the Jaccard similarity of the shingle sets. near_duplicates() bands the signatures, joins the bands in Spark
and verifies the Jaccard similarity of what meets.

Defined cases: null is empty; a text without words has the fingerprint of the empty set, which is like itself only; a
text under five words is one shingle; repeated rows get equal fingerprints. In with_next(), rows are ordered by id, then
text, so that rows sharing an id follow one another; one row alone is its own next one. A row whose id is null has no place
in that order: it is its own next one, and nobody else's. An empty table gives no rows; other columns are not read.

with_next() keeps a table of cut points in every task: MOST_BUCKETS at most, of 20 bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linkage
from .common import give_back, map_batches, mix, pieces, shingle_hashes, texts_of

PERMS, WIDTH, BANDS, THRESHOLD = 128, 5, 32, 0.8
#: Rows of a bucket of with_next(), about; and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 400, 400_000
_RNG = np.random.Generator(np.random.PCG64(20240117))
_A = _RNG.integers(0, 1 << 63, PERMS, np.uint64) << np.uint64(1) | np.uint64(1)
_B = _RNG.integers(0, (1 << 64) - 1, PERMS, np.uint64)


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The signatures (uint16, one row a text) of the shingles hashes[begin[i]:begin[i + 1]] of each text i."""
    n = len(begin) - 1
    out = np.full((n, PERMS), np.uint64((1 << 64) - 1))
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        starts = begin[full]
        # groups of texts of about 16k shingles, which fit a core's cache
        edges = np.searchsorted(starts, np.arange(0, int(begin[-1]) + 1, 16_384))
        cuts = np.unique(np.concatenate((edges, [0, len(full)])))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            first = starts[lo]
            h = hashes[first : begin[full[hi - 1] + 1]]
            at, rows = starts[lo:hi] - first, full[lo:hi]
            v = np.empty_like(h)
            for k in range(PERMS):
                np.multiply(h, _A[k], out=v)
                v += _B[k]
                out[rows, k] = np.minimum.reduceat(v, at)
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def sketch(texts: list[str]) -> np.ndarray:
    return signatures(*shingle_hashes(texts, WIDTH))


def _hex(sig: np.ndarray) -> list[str]:
    flat, step = np.ascontiguousarray(sig.astype(">u2")).tobytes().hex(), 4 * PERMS
    return [flat[i : i + step] for i in range(0, len(flat), step)]


def fingerprints(docs: DataFrame, *, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(by, fingerprint) of every row."""
    kind = docs.schema[by].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(sketch(texts_of(batch, "t"))), pa.string())], [by, "fingerprint"])

    return map_batches(docs.select(F.col(by).alias("i"), F.col(text).alias("t")), each, f"`{by}` {kind}, fingerprint string")


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(by, class_id, group_id) of every row: equal texts share class_id, texts linked by a Jaccard similarity of threshold or more share group_id."""

    def bands(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, begin = shingle_hashes(texts, WIDTH)
        sig = signatures(hashes, begin)
        size = np.array([len(np.unique(hashes[begin[i] : begin[i + 1]])) for i in range(len(texts))], np.int64)
        return linkage.band_keys(sig.astype(np.uint64), BANDS), (sig & 0xFF).astype(np.uint8), size

    def likeness(a: np.ndarray, b: np.ndarray) -> float:
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / max(1, len(a) + len(b) - both)

    return linkage.groups(docs, bands, likeness, threshold, width=WIDTH, text=text, by=by)


def with_next(docs: DataFrame, fn, schema: str, *, text: str = "text", by: str = "doc_id") -> DataFrame:
    """Calls fn(ids, texts, index of each one's next text) on runs of consecutive rows in ascending (by, text); after the last comes the first.

    Only one shuffle moves texts: rows go to ranges of ids, and the first row of each range also to the range before, where it
    follows the last.
    """
    src = docs.select(F.col(by).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # cut points of about BUCKET_ROWS rows each, by rank; a few longs for each bucket go to the driver
    spark = docs.sparkSession
    rows = src.count()
    n = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    found = None
    if n > 1:  # the shares are one literal in the plan
        shares = F.split(F.lit(",".join(f"{k / n:.9f}" for k in range(1, n))), ",").cast("array<double>")
        found = src.agg(F.percentile_approx("i", shares, 20_000 if n < 10_000 else 4 * n)).first()[0]
    sent = spark.sparkContext.broadcast(np.unique(np.array(found or [], np.int64)))

    @F.pandas_udf("int")
    def bucket(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, i.to_numpy(np.int64), side="right").astype(np.int32))

    firsts = sorted((r["b"], r["i"]) for r in src.select("i").where(F.col("i").isNotNull()).groupBy(bucket("i").alias("b")).agg(F.min("i").alias("i")).collect())
    before = {i: firsts[k - 1][0] for k, (_, i) in enumerate(firsts)}
    turns = spark.sparkContext.broadcast((np.array(sorted(before), np.int64), np.array([before[i] for i in sorted(before)], np.int32)))

    @F.pandas_udf("array<int>")
    def places(i: pd.Series) -> pd.Series:
        ids, (begins, prev) = i.to_numpy(np.int64), turns.value
        at = np.minimum(np.searchsorted(begins, ids), len(begins) - 1)
        own = np.searchsorted(sent.value, ids, side="right")
        return pd.Series([[o, p] if first else [o] for o, p, first in zip(own, prev[at], begins[at] == ids, strict=True)])

    dealt = src.where(F.col("i").isNotNull()).select("i", "t", F.posexplode(places("i")).alias("tail", "b")).repartition(-(-n // 8), "b").sortWithinPartitions("b", "tail", "i", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, nexts, extra = [], [], [], []
        held = None  # the last row of a bucket that has not met its next one

        def flush():
            at = {}
            for k, x in enumerate(extra):
                at.setdefault(x, len(texts) + k)
            out = fn(ids, texts + extra, [k + 1 if x is None else at[x] for k, x in enumerate(nexts)])
            for x in (ids, texts, nexts, extra):
                x.clear()
            return out

        size = 0
        for batch in batches:
            for i, t, tail, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[2] == b:
                    ids.append(held[0])
                    texts.append(held[1])
                    size += len(held[1])
                    if size > 4 << 20 or tail:
                        nexts.append(t)
                        extra.append(t)
                        if size > 4 << 20:
                            size = 0
                            yield flush()
                    else:
                        nexts.append(None)
                    held = None if tail else (i, t, b)
                elif not tail:
                    held = (i, t, b)
        if ids:
            yield flush()
        give_back()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield fn([None] * part.num_rows, texts_of(part, "t"), list(range(part.num_rows)))
        give_back()

    return dealt.mapInArrow(run, schema).unionByName(src.where(F.col("i").isNull()).mapInArrow(alone, schema))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def edit_report(docs: DataFrame, *, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(by, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row, by with_next()."""

    def fn(ids: list[int], texts: list[str], nexts: list[int]) -> pa.RecordBatch:
        k = len(ids)
        changed = [edited(t, texts[x]) for t, x in zip(texts[:k], nexts, strict=True)]
        sig, sig_changed = sketch(texts), sketch(changed)
        near = lambda a, b: pa.array((a == b).mean(1), pa.float64())
        out = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:k]], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()), pa.array(_hex(sig[:k]), pa.string()), pa.array(_hex(sig_changed), pa.string()), near(sig[:k], sig_changed), near(sig[:k], sig[nexts])]
        return pa.RecordBatch.from_arrays(out, [by, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, fn, f"`{by}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", text=text, by=by)
