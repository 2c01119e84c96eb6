"""Rendezvous (highest-random-weight) sharding of stable record keys over weighted shards, in DataFrame functions alone.

For each shard s of weight w the key's score is -w / ln(u), u a uniform number made of MD5(key, s); the largest score
wins. The key and the set of shards decide; a new shard takes keys only into itself, and in proportion to its weight.

Slots are gapless in a shard without a sort over a whole shard: rows are numbered in each (input split, shard), splits
are put one after another by a running sum of their counts, and both meet in a join on (split, shard). So no group is
larger than an input split, whatever key, text or shard is frequent.

A null text has no bytes (size 1, CRC-32 of nothing: 0). A null doc_id is one key of its own, the text "null" aside.
Repeated rows go to one shard and get a slot each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The hexadecimal digits of the digest that make u: 52 bits fit a double without rounding.
DIGITS = 13


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that ``key`` (a string column) goes to; equal scores go to the smaller number.

    A shard of weight zero or less takes no key.
    """
    scores = [
        F.struct((F.lit(float(w)) / -F.ln((F.conv(F.substring(F.md5(F.concat(key, F.lit(f"@{s}"))), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS)))).alias("score"), F.lit(-s).alias("s"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    if not scores:
        raise ValueError("no shard has a weight")
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0]).getField("s")).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard under the weights ``grown``) for every row."""
    key = F.coalesce(F.concat(F.lit("k"), F.col(doc_id).cast("string")), F.lit("null"))
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    from .common import stored

    rows = stored(rows, "shards")
    place = Window.partitionBy("split", "shard")
    own = rows.withColumn("local", F.row_number().over(place.orderBy("doc_id", "at")).cast("long") - 1)
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("split", "shard").count().select("split", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return own.join(starts, ["split", "shard"]).select(F.col("doc_id").alias(doc_id), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("local")).alias("slot"), "grown_shard")
