"""Connected components of a distributed edge table, by alternating large-star and small-star rounds.

No node, edge or component goes to the driver but the counts that tell when a round changed nothing. Each round is
written to the shared folder and read again, which cuts the lineage; the round before it is deleted. Minima are partial
aggregates and joins are on node keys, which adaptive execution can split, so a node with very many neighbours does not
gather in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the least node that each node of ``edges`` can reach; self-loops and nulls are left out.

    The number of rounds grows with the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    pairs = stored(pairs, "edges")
    before = None
    while (now := _signature(pairs)) != before:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, pairs, before = pairs, stored(small, "edges"), now
        drop_stored(old)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
