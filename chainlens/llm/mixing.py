"""Mixing sources to target weights by hierarchical budgets.

The leaves of a tree (domain, language, source) have tokens. A budget of tokens goes down the tree: at each node it is
split among the children by weight, no child gets more than its leaves can give (their tokens times max_epochs), and what
one child can't take goes to its siblings by their weights before any of it returns to an ancestor's children. As a node's
capacity is the sum of its leaves', one pass from the root does this exactly: children are ranked by capacity per weight,
those under the water line are filled, the others share the rest. All of it is integer arithmetic; shares are rounded down.

A leaf that gets b of its a tokens gives b // a whole epochs, and of one more epoch the longest prefix of its documents, in
that epoch's seeded order (MD5 of seed, epoch and id), that stays within the rest. The prefix is found by totals of BUCKETS
ranges of the order and, within the one range where it ends, by a running sum; so a source that holds a third of all rows is
never in one task. What leaves a cut is then a comparison of strings.

Defined cases: null levels are nodes named ""; a null text, as one without words, has no tokens; rows with the same id and
leaf are in the same places of the orders, and go together; a weight of 0 gets nothing unless no sibling has weight; an
empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, measured, stored

BUCKETS_HEX = 3  # hexadecimal digits: 4096 ranges of each leaf


def tokens_of(text: Column) -> Column:
    """Runs of anything but space, tab and line breaks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, by: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), by.cast("string")).cast("binary"))


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1)).cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], total: int, max_epochs: int) -> DataFrame:
    """leaves (levels, avail) with the tokens that each gets: alloc."""
    caps = leaves.withColumn("cap", F.col("avail") * max_epochs)
    given = None
    for depth, level in enumerate(levels):
        up, path = list(levels[:depth]), list(levels[: depth + 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights.get(level, {})))
        nodes = nodes.withColumn("budget", F.lit(int(total)).cast("long")) if given is None else nodes.join(given, up)
        own = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(0))
        nodes = nodes.withColumn("w", F.when(F.sum("w").over(own) == 0, F.lit(1)).otherwise(F.col("w")).cast("long"))
        rank = own.orderBy(F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(float("inf"))), level)
        before = F.coalesce(F.sum("cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(rank.rowsBetween(0, Window.unboundedFollowing))
        # decimals, as products of tokens and weights may exceed a long
        wide = lambda c: c.cast("decimal(38,0)") if isinstance(c, Column) else F.col(c).cast("decimal(38,0)")
        nodes = nodes.withColumn("before", before).withColumn("rest", rest)
        nodes = nodes.withColumn("full", (F.col("w") > 0) & (F.col("cap") * F.col("rest") <= (F.col("budget") - F.col("before")) * F.col("w")))
        nodes = nodes.withColumn("filled", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(own), F.lit(0))).withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(own), F.lit(0)))
        share = F.when(F.col("open") > 0, F.floor(wide(F.col("budget") - F.col("filled")) * wide("w") / wide("open"))).otherwise(F.lit(0)).cast("long")
        given = nodes.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), share)).cast("long").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "alloc"), list(levels))


def plan(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], *, total: int | None = None, share: tuple[int, int] = (3, 5), max_epochs: int = 3, seed: int = 17, text: str = "text", by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(slim, leaves): slim has id, levels l0..., tokens of every row; leaves has levels, avail, alloc, whole epochs and the cut of the next epoch's order.

    total: tokens to give out; None: share of all the tokens there are.
    """
    names = [f"l{i}" for i in range(len(levels))]
    slim = stored(docs.select(F.col(by).alias("id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)], tokens_of(F.col(text)).alias("tokens")), "tokens")
    weights = {n: weights.get(level, {}) for n, level in zip(names, levels, strict=True)}
    leaves = stored(slim.groupBy(*names).agg(F.sum("tokens").alias("avail")), "leaves")
    if total is None:
        total = (leaves.agg(F.sum("avail")).first()[0] or 0) * share[0] // share[1]
    given = stored(budgets(leaves, names, weights, total, max_epochs).select(*names, "avail", "alloc", F.when(F.col("avail") > 0, F.expr("alloc div avail")).otherwise(F.lit(0)).alias("whole")).withColumn("left", F.col("alloc") - F.col("avail") * F.col("whole")), "budgets")
    part = slim.join(measured(given.where("left > 0").select(*names, "whole", "left")), names).withColumn("o", order_key(seed, F.col("whole"), F.col("id"))).withColumn("b", F.substring("o", 1, BUCKETS_HEX))
    sums = part.groupBy(*names, "b", "left").agg(F.sum("tokens").alias("t"))
    run = Window.partitionBy(*names).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    ends = stored(sums.withColumn("upto", F.sum("t").over(run)).where(F.col("upto") > F.col("left")).groupBy(*names).agg(F.min(F.struct("b", (F.col("upto") - F.col("t")).alias("before"))).alias("e")).select(*names, F.col("e.b").alias("eb"), F.col("e.before").alias("before")), "ends")
    last = part.join(measured(ends), names).where(F.col("b") == F.col("eb"))
    within = F.sum("tokens").over(Window.partitionBy(*names, "b").orderBy("o"))  # rows of equal o count together
    fit = last.withColumn("upto", F.col("before") + within).where(F.col("upto") <= F.col("left")).groupBy(*names).agg(F.max("o").alias("fit"))
    cut = ends.join(fit, names, "left").select(*names, F.coalesce("fit", "eb").alias("cut"))
    out = stored(given.join(cut, names, "left"), "plan")
    dropped(ends)
    dropped(leaves)
    return slim, out


def _epochs(seed: int, by: Column) -> Column:
    extra = F.col("cut").isNotNull() & (order_key(seed, F.col("whole"), by) <= F.col("cut"))
    upto = F.when(extra, F.col("whole")).otherwise(F.col("whole") - 1)
    return F.when(upto >= 0, F.sequence(F.lit(0).cast("long"), upto.cast("long"))).otherwise(F.array().cast("array<long>"))


def chosen(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], *, seed: int = 17, by: str = "doc_id", **options) -> DataFrame:
    """(by, levels, tokens, alloc, epoch): a row for each document and epoch that it is chosen in."""
    slim, leaves = plan(docs, levels, weights, seed=seed, by=by, **options)
    names = [f"l{i}" for i in range(len(levels))]
    met = slim.join(measured(leaves), names)
    return met.select(F.col("id").alias(by), *[F.col(n).alias(level) for n, level in zip(names, levels, strict=True)], "tokens", "alloc", F.explode(_epochs(seed, F.col("id"))).alias("epoch"))


def mixed(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], *, seed: int = 17, by: str = "doc_id", **options) -> DataFrame:
    """docs with the chosen rows, once for each epoch; columns stay as they are."""
    slim, leaves = plan(docs, levels, weights, seed=seed, by=by, **options)
    dropped(slim)
    names, columns = [f"l{i}" for i in range(len(levels))], docs.columns
    keyed = docs.select(F.struct("*").alias("row"), F.col(by).alias("id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)])
    met = keyed.join(measured(leaves), names)
    return met.select("row", F.explode(_epochs(seed, F.col("id")))).select(*[F.col("row").getField(c).alias(c) for c in columns])
