"""Connected components of a distributed edge list (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of (u, v) edges of longs.

    Every round is joins and minima over edges; nothing is gathered on the driver
    but whether a round changed something.  Repeated edges and loops don't matter; no
    edges give no rows.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    pairs = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    signature = None
    for _ in range(most_rounds):
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        small = _least(both).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _least(large)
        after = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = materialise(after, "edges")
        drop_table(pairs)
        pairs = after
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature or not now[0]:
            break
        signature = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(_least(pairs).withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
