"""Two snapshots compared: added, gone, moved, unchanged, re-clustered.

Each side keeps the last row per key (not the merged one); one full outer join
on the key classifies.  Nulls are asymmetric: a count that appears has moved
from 0, one that disappears is unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_rows(df: DataFrame, key: Column, label: Column, count: Column, order: str) -> DataFrame:
    rows = df.select(key.alias("key"), F.struct(label.alias("label"), count.alias("count")).alias("r"), F.col(order).alias("o")).where("key is not null")
    return rows.groupBy("key").agg(F.max_by("r", "o").alias("r")).select("key", "r.label", "r.count")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``key``, ``label``, ``status`` ('added', 'gone', 'moved', 'same'), ``before``, ``after``, ``change``
    of two outputs of :func:`last_rows`."""
    b = before.select("key", F.col("label").alias("bl"), F.col("count").alias("bc"), F.lit(True).alias("b"))
    a = after.select("key", F.col("label").alias("al"), F.col("count").alias("ac"), F.lit(True).alias("a"))
    j = b.join(a, "key", "full_outer")
    moved = F.col("ac").isNotNull() & ~F.col("bc").eqNullSafe(F.col("ac"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "gone").when(moved, "moved").otherwise("same")
    was, now = F.coalesce("bc", F.lit(0)), F.col("ac")
    return j.select(
        "key", F.coalesce("al", "bl").alias("label"), status.alias("status"), F.when(status == "moved", was).alias("before"), F.when(status == "moved", now).alias("after"), F.when(status == "moved", now - was).alias("change")
    )


def reclustered(delta: DataFrame) -> DataFrame:
    """Labels both added and gone: the same work under another key."""
    return delta.where("status = 'added'").select("label").intersect(delta.where("status = 'gone'").select("label")).orderBy("label")


def movers(delta: DataFrame) -> DataFrame:
    return delta.where("status = 'moved'").orderBy(F.desc(F.abs("change")), "label", "key")


def delta_summary(delta: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = delta.agg(n("added"), n("gone"), n("moved"), n("same"), F.coalesce(F.sum("change"), F.lit(0)).alias("citations_gained"))
    return out.withColumn("quiet", (F.col("added") == 0) & (F.col("gone") == 0) & (F.col("moved") == 0))
