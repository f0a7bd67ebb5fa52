"""Connected components by alternating large-star and small-star contraction.

Every round is a keyed minimum and an equi-join, so no task gathers a
component; the edge list shrinks to stars in a logarithmic number of rounds.
Each round is written to the shared folder, which cuts the lineage and survives
lost executors.  Edges with a null end are left out; loops and repeated edges
change nothing; an empty edge list gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``edges`` (u, v), u > v: every node's neighbours tied to its least one."""
    if small:
        near = edges
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = near.join(least, "u")
    if small:
        out = tied.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    else:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the least node of it), for every node that has an edge to another."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null")
    e = materialize(e.where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        e = materialize(_star(_star(e, small=False), small=True))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
