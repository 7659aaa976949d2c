"""Connected components of a graph given as an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from locusweave.llm.storage import stored


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): the edges with ``m`` the smallest of u and its neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(low, "u", "left").withColumn("m", F.least("u", F.coalesce("low", "u"))).drop("low")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``edges`` (two id columns of one orderable type) to (node, component): the smallest id reachable.

    Only nodes with an edge to another node appear.  Edges with a null end and loops are
    ignored, repeated edges count once, and an empty table gives an empty one.  Each round
    stores its edges in the shared folder; neither edges nor labels pass through the driver,
    only a row count and a sum of hashes that show whether a round changed anything.
    Hubs are pre-aggregated (``min`` combines before the shuffle) and skewed joins split by AQE.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    # every edge points from the larger to the smaller end
    pairs = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _neighbour_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _neighbour_minimum(large.where("u <> v"))
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        pairs = stored(small.where("u <> v").distinct())
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return members.union(roots).distinct()
