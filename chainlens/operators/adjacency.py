"""Comparisons of rows with the row before, on tables: links, sequences, times; first failures, flags and ends.

The order's range is cut into buckets by the values of its first key: first at CUTS approximate quantiles at most, so that
neither outliers nor values that cluster fill one bucket, then each range into equal widths. Rows are compared inside their
bucket, and only the first row of a bucket is looked up in a table that has the last row of each. So there is no window
over the whole table. A value of the first key is never split: rows that tie in it share a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import splits

#: Rows of a bucket, about.
ROWS = 200_000
#: Quantiles that ranges are cut at, at most.
CUTS = 255


def with_previous(table: DataFrame, order: Sequence[Column], columns: Sequence[str], rows: int = ROWS) -> DataFrame:
    """table with prev_<column> of each of columns, from the row before in order; null in the first row. has_prev tells whether there is one.

    order: numeric columns, the first of which cuts the buckets; together they should tell all rows apart.
    """
    key = order[0].cast("double")
    low, high, n = table.agg(F.min(key), F.max(key), F.count("*")).first()
    buckets = max(1, -(-n // rows))
    bucket = F.lit(0)
    if buckets > 1:
        ranges = min(buckets, CUTS + 1)
        cuts = table.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10_000)).first()[0]
        bucket = _bucket(key, sorted({low, *cuts, high}), -(-buckets // ranges))
    names = [f"__o{i}" for i in range(len(order))]
    own = table.select("*", *[o.alias(x) for o, x in zip(order, names, strict=True)], F.coalesce(bucket, F.lit(0)).alias("__b"))
    inside = Window.partitionBy("__b").orderBy(*names)
    row = F.struct(*columns)
    marked = own.withColumn("__p", F.lag(row).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    last = own.groupBy("__b").agg(F.max_by(row, F.struct(*names)).alias("__l"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    last = last.select("__b", F.last("__l").over(ahead).alias("__before"))
    met = marked.join(splits.small(last, buckets), "__b")
    before = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__p"))
    out = met.withColumn("__prev", before)
    return out.select(*[F.col(c) for c in table.columns], *[F.col(f"__prev.{c}").alias(f"prev_{c}") for c in columns], F.col("__prev").isNotNull().alias("has_prev"))


def _bucket(key: Column, cuts: list[float], parts: int) -> Column:
    """The number of key's bucket: of the ranges between cuts, found by halving, each has parts of equal width."""

    def at(i: int, j: int) -> Column:
        if j - i <= 1:
            width = (cuts[min(j, len(cuts) - 1)] - cuts[i]) / parts or 1.0
            return F.lit(i * parts) + F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((key - F.lit(cuts[i])) / F.lit(width))))
        k = (i + j) // 2
        return F.when(key < F.lit(cuts[k]), at(i, k)).otherwise(at(k, j))

    return at(0, max(1, len(cuts) - 1)).cast("int")


def sequence_gaps(rows: DataFrame, sequence: str) -> DataFrame:
    """(sequence, expected, previous) of rows with has_prev and prev_<sequence> whose sequence isn't the next."""
    previous = F.col(f"prev_{sequence}")
    return rows.where(F.col("has_prev") & (F.col(sequence) != previous + 1)).select(F.col(sequence).alias("sequence"), (previous + 1).alias("expected"), previous.alias("previous"))


def time_regressions(rows: DataFrame, sequence: str, ns: str) -> DataFrame:
    previous = F.col(f"prev_{ns}")
    return rows.where(F.col("has_prev") & (F.col(ns) < previous)).select(F.col(sequence).alias("sequence"), F.col(ns).alias("timestamp_ns"), previous.alias("previous_ns"))


def link_breaks(rows: DataFrame, sequence: str, declared: str, digest: str, genesis: str) -> DataFrame:
    """Rows whose declared link isn't the digest of the row before, or genesis in the first row."""
    expected = F.when(F.col("has_prev"), F.col(f"prev_{digest}")).otherwise(F.lit(genesis))
    return rows.where(F.col(declared) != expected).select(F.col(sequence).alias("sequence"), expected.alias("expected"), F.col(declared).alias("found"))


def integrity(rows: DataFrame, *, sequence: str, ns: str, declared: str, digest: str, genesis: str, signed: Column) -> DataFrame:
    """One row of four flags, all false for a table without rows."""
    link = F.when(F.col("has_prev"), F.col(declared) == F.col(f"prev_{digest}")).otherwise(F.col(declared) == F.lit(genesis))
    contiguous = F.when(F.col("has_prev"), F.col(sequence) == F.col(f"prev_{sequence}") + 1).otherwise(F.col(sequence) == 1)
    monotonic = ~F.col("has_prev") | (F.col(ns) >= F.col(f"prev_{ns}"))
    claim = lambda c: F.coalesce(F.bool_and(c), F.lit(False))
    return rows.agg(claim(link).alias("prev_hash_links_ok"), claim(contiguous).alias("sequence_contiguous"), claim(monotonic).alias("timestamps_monotonic"), claim(signed).alias("all_signed"))


def ends(table: DataFrame, order: Column, columns: Sequence[str]) -> DataFrame:
    """One row of first_ and last_ values in an order (not least and greatest ones)."""
    return table.agg(*[f(F.col(c), order).alias(f"{name}_{c}") for c in columns for name, f in (("first", F.min_by), ("last", F.max_by))])


def first_failure(failures: DataFrame, order: Sequence[str]) -> DataFrame:
    """The failure that comes first."""
    return failures.orderBy(*order).limit(1)
