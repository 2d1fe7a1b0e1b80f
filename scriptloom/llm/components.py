"""Connected components of a large edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, skew_join, stored


def _starred(pairs: DataFrame, keep: str) -> DataFrame:
    """For each u with neighbours v: link those v that ``keep`` names, and u itself, to the least of u and all v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = skew_join(pairs, least, "u")
    if keep == "larger":
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # every v is smaller than u
        out = linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of any one orderable type to ``(u, root)``: each vertex of an edge with the least of its component.

    Loops, repeated edges and rows with a null end change nothing; without edges the result is empty. A round is two
    joins and aggregations on the edge table alone; a hub's rows are split by adaptive execution. Rounds grow with the
    logarithm of a component's width. Nothing but two numbers a round goes to the driver.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, before = stored(edges.distinct()), None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        last, edges = edges, stored(_starred(_starred(both, "larger"), "smaller"))
        release(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("root"))
    return edges.select("u", F.col("v").alias("root")).unionByName(roots)
