"""Citation graph: edges from all observations, nodes from the kept records.

A record found by listing the works that cite X cites X.  X is a kept record
whose own citing id is X, else a stub.  Everything is equi-joins and keyed
aggregates; components are contracted iteratively.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cited_target, parse_id, work_key
from ..functions.text import filled
from ..session import materialize
from .components import connected_components


def nodes_of(kept: DataFrame, order: str) -> DataFrame:
    """``key``, ``label``, ``year``, ``citations``, ``depth``, ``own`` (its citing id): the first row per key."""
    label = F.coalesce(filled(F.trim(F.regexp_replace(F.col("title"), r"\s+", " "))), F.lit("untitled"))
    rows = kept.select(
        work_key(F.col("cluster_id"), F.col("title"), F.col("link")).alias("key"), F.col(order).alias("o"),
        F.struct(label.alias("label"), "year", F.coalesce("cited_by_count", F.lit(0)).alias("citations"), F.coalesce("extra.follow_depth", F.lit(0)).alias("depth")).alias("r"),
        parse_id(F.col("cited_by_url")).alias("own"),
    )
    return rows.groupBy("key").agg(F.min_by("r", "o").alias("r"), F.min("o").alias("first")).select("key", "r.*", "first")


def build_edges(observations: DataFrame, kept: DataFrame, order: str) -> DataFrame:
    """``citing``, ``cited``, ``stub`` (the cited one is not collected), ``first``: distinct, no loops."""
    key = work_key(F.col("cluster_id"), F.col("title"), F.col("link"))
    drawn = kept.select(key.alias("citing")).distinct()
    owner = kept.select(parse_id(F.col("cited_by_url")).alias("target"), key.alias("k"), F.col(order).alias("o")).where("target is not null")
    owner = owner.groupBy("target").agg(F.max_by("k", "o").alias("cited"))
    seen = observations.select(key.alias("citing"), cited_target(F.col("query")).alias("target"), F.col(order).alias("o")).where("target is not null")
    seen = seen.groupBy("citing", "target").agg(F.min("o").alias("o")).join(drawn, "citing", "left_semi").join(owner, "target", "left")
    out = seen.select("citing", F.coalesce("cited", F.concat(F.lit("cites:"), F.col("target"))).alias("cited"), F.col("cited").isNull().alias("stub"), "o")
    return out.where("citing <> cited").groupBy("citing", "cited", "stub").agg(F.min("o").alias("first"))


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kept nodes and the stubs of uncollected targets."""
    stubs = edges.where("stub").groupBy(F.col("cited").alias("key")).agg(F.min("first").alias("first"))
    stubs = stubs.select("key", F.col("key").alias("label"), F.lit(None).cast("long").alias("year"), F.lit(0).cast("long").alias("citations"), F.lit(0).cast("long").alias("depth"), "first", F.lit(True).alias("stub"))
    return nodes.withColumn("stub", F.lit(False)).unionByName(stubs)


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("cited").alias("key")).agg(F.count(F.lit(1)).alias("in_degree"), F.min("first").alias("first"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("citing").alias("key")).agg(F.count(F.lit(1)).alias("out_degree"))


def hubs(edges: DataFrame, n: int = 5) -> DataFrame:
    return in_degree(edges).orderBy(F.desc("in_degree"), "first").limit(n)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Collected nodes without any edge."""
    touched = edges.select(F.col("citing").alias("key")).unionByName(edges.select(F.col("cited").alias("key")))
    return nodes.join(touched, "key", "left_anti")


def components(nodes: DataFrame, edges: DataFrame, key: str = "key") -> DataFrame:
    """``key``, ``component`` (its least key); a node without edges is a component of its own."""
    found = connected_components(edges, "citing", "cited").withColumnRenamed("node", key)
    return nodes.select(key).distinct().join(found, key, "left").withColumn("component", F.coalesce("component", key))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``component``, ``size``, ``first_key`` (its earliest node) of every component, largest first, ties by the earliest."""
    parts = components(nodes, edges).join(nodes.select("key", "first"), "key")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("first", "key")).alias("f"))
    return sizes.orderBy(F.desc("size"), "f").select("component", "size", F.col("f.key").alias("first_key"))


def network_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    nodes, edges = materialize(nodes), materialize(edges)  # each is read several times
    n = all_nodes(nodes, edges)
    sizes = components(n, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    one = lambda name, df, value: df.agg(value.cast("long").alias("v")).select(F.lit(name).alias("k"), "v")
    rows = [
        one("collected", n, F.count_if(~F.col("stub"))), one("uncollected", n, F.count_if("stub")), one("edges", edges, F.count(F.lit(1))), one("components", sizes, F.count(F.lit(1))),
        one("largest", sizes, F.max("size")), one("isolated", isolated(nodes, edges), F.count(F.lit(1))),
    ]
    names = ("collected", "uncollected", "edges", "components", "largest", "isolated")
    return reduce(DataFrame.unionByName, rows).agg(*[F.max(F.when(F.col("k") == x, F.col("v"))).alias(x) for x in names])


def next_level(results: DataFrame, visited: DataFrame, breadth: int, floor: int = 0, order: str = "obs_id") -> DataFrame:
    """``cites_id``, ``citations``: the works worth following next, most cited first, ``breadth`` in all."""
    rows = results.select(parse_id(F.col("cited_by_url")).alias("cites_id"), F.coalesce("cited_by_count", F.lit(0)).alias("citations"), F.col(order).alias("o"))
    rows = rows.where((F.col("citations") >= floor) & F.col("cites_id").isNotNull())
    best = rows.groupBy("cites_id").agg(F.max(F.struct("citations", (-F.col("o")).alias("o"))).alias("b"))
    best = best.join(visited.select("cites_id").distinct(), "cites_id", "left_anti")
    return best.orderBy(F.desc("b")).limit(breadth).select("cites_id", F.col("b.citations").alias("citations"))


def follow(seeds: DataFrame, listings: DataFrame, depth: int, breadth: int, floor: int = 0, order: str = "obs_id") -> DataFrame:
    """Level-wise walk over stored listings (their ``query`` says ``cites:<id>``): the chosen
    ``cites_id`` with its ``level`` and ``citations``; at most ``depth`` times ``breadth`` rows."""
    if depth < 0 or breadth < 1 or floor < 0:
        raise ValueError("usage: depth and floor must not be negative, breadth at least 1")
    spark = seeds.sparkSession
    visited = spark.createDataFrame([], "cites_id string")
    out, level = spark.createDataFrame([], "cites_id string, citations long, level int"), seeds
    for k in range(1, depth + 1):
        chosen = next_level(level, visited, breadth, floor, order)
        rows = chosen.collect()  # at most `breadth`
        if not rows:
            break
        chosen = spark.createDataFrame(rows, "cites_id string, citations long")
        out = out.unionByName(chosen.withColumn("level", F.lit(k)))
        visited = visited.unionByName(chosen.select("cites_id"))
        level = listings.join(F.broadcast(chosen.select(F.concat(F.lit("cites:"), "cites_id").alias("query"))), "query", "left_semi")
    return out

