"""Sharding by size: shards of near-equal bytes, cut from global prefix sums. DataFrame functions only.

Documents of equal text are one group and stay together. Groups that exceed a sixty-fourth of a shard come first, largest
first (there can be at most 64 times the shards of them, whatever the input); all others follow by the MD5 of their text:
shards are contiguous in this order, not in that of ids. Prefix sums come from totals of BUCKETS ranges of that order plus
sums within each range, so no task sorts everything. A shard is what lies between two equal targets of the sum; a group
lies where its middle lies. A group larger than what a shard should still get has a shard of its own, and the targets of
the rest are set anew. Slots follow the MD5 of id, checksum and size.

Texts are read and hashed once, into a written table of 50 bytes a row, on which everything else is built.

Defined cases: a null text has no bytes and is equal to the empty one; its size is 1; rows that repeat an id, or have a
null one, are placed like any other, in an order that their size and checksum decide; rows that tie in all of these are
alike; very long texts are groups like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

SHARDS, BUCKETS, LAW = 8, 4096, "bytes"


def plan_heavy(sizes: list[int], total: int, shards: int) -> tuple[int, int]:
    """How many of the heaviest groups (sizes fall) get a shard of their own, and the bytes these have."""
    alone = own = 0
    for s in sizes:
        if alone >= shards - 1 or s * (shards - alone) <= total - own:
            break
        alone, own = alone + 1, own + s
    return alone, own


def sharded(docs: DataFrame, shards: int = SHARDS, *, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(by, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = stored(docs.select(F.col(by), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.unhex(F.md5(whole)).alias("g")), "sizes")
    groups = stored(slim.groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy_from = max(1, total // (shards * 64))
    heavy = groups.where(F.col("bytes") > heavy_from).orderBy(F.desc("bytes"), "g").collect()  # 64 * shards rows at most
    alone, own = plan_heavy([r["bytes"] for r in heavy], total, shards)
    rest, left = max(1, total - own), shards - alone
    # the heavy groups' shards; the light ones go on from the bytes of those heavy ones that have no shard of their own
    placed, start = [], 0
    for k, r in enumerate(heavy):
        if k < alone:
            placed.append((bytes(r["g"]).hex(), k))
        else:
            placed.append((bytes(r["g"]).hex(), alone + min(left - 1, (2 * start + r["bytes"]) * left // (2 * rest))))
            start += r["bytes"]
    literals = ", ".join(f"(X'{g}', {s})" for g, s in placed) or "(X'', 0)"
    heavy_shards = spark.sql(f"SELECT g, shard FROM VALUES {literals} AS v(g, shard)")
    light = groups.where(F.col("bytes") <= heavy_from).withColumn("b", _bucket("g"))
    before = light.groupBy("b").agg(F.sum("bytes").alias("t")).select("b", (F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t") + F.lit(start)).alias("before"))  # BUCKETS rows at most
    within = F.sum("bytes").over(Window.partitionBy("b").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    middle = (F.col("before") + F.col("within")) * 2 + F.col("bytes")
    light_shards = light.withColumn("within", within).join(F.broadcast(before), "b").select(F.col("g").alias("key"), (F.lit(alone) + F.least(F.lit(left - 1), F.floor(middle * F.lit(left) / F.lit(2 * rest)))).cast("int").alias("light"))
    # heavy groups' rows get their shard from the few literals; they meet the rest's table by a key of their own row, so no key is hot
    order = F.unhex(F.md5(F.concat_ws("|", F.col(by).cast("string"), "text_crc32", "size").cast("binary")))
    marked = slim.join(F.broadcast(heavy_shards), "g", "left").withColumn("o", order)
    key = F.when(F.col("shard").isNull(), F.col("g")).otherwise(F.concat("o", F.lit(b"heavy")))
    placed_rows = marked.withColumn("key", key).join(light_shards, "key", "left").select(by, "size", "text_crc32", F.coalesce("shard", "light").alias("shard"), "o")
    rows = stored(placed_rows.withColumn("b", _bucket("o")), "placed")
    dropped(slim)
    dropped(groups)
    counts = rows.groupBy("shard", "b").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "b", (F.sum("n").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))  # shards * BUCKETS rows at most
    rank = F.row_number().over(Window.partitionBy("shard", "b").orderBy("o", by, "text_crc32", "size")) - 1
    return rows.withColumn("r", rank).join(F.broadcast(offsets), ["shard", "b"]).select(by, "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("first") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _bucket(digest: str) -> Column:
    return F.conv(F.substring(F.hex(digest), 1, 3), 16, 10).cast("int")
