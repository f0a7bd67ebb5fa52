"""Staleness: age, weight, ranking and what to fetch again; the clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import refresh_id
from ..functions.text import clip, filled, strip
from ..functions.times import iso_timestamp

DEFAULT_DAYS, DEFAULT_LIMIT = 30, 20


def age_days(stamp: Column, now: Column) -> Column:
    """Days since an ISO stamp (negative for the future); null if it cannot be read."""
    return (F.unix_micros(now) - F.unix_micros(iso_timestamp(stamp))) / F.lit(86_400_000_000.0)


def pressure(age: Column, count: Column) -> Column:
    return age * F.log10(1 + F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)))


def rank_stale(df: DataFrame, now: Column, days: float = DEFAULT_DAYS, order: str = "obs_id") -> DataFrame:
    """``df`` with ``age_days``, ``pressure``, ``target`` for rows at least ``days`` old, heaviest first."""
    aged = df.withColumn("age_days", age_days(F.col("fetched_at"), now)).where(F.col("age_days") >= days)
    aged = aged.withColumn("pressure", pressure(F.col("age_days"), F.col("cited_by_count"))).withColumn("target", refresh_id(F.col("versions_url"), F.col("cited_by_url")))
    return aged.orderBy(F.desc("pressure"), F.desc("age_days"), order)


def refresh_targets(ranked: DataFrame, limit: int = DEFAULT_LIMIT, order: str = "obs_id") -> DataFrame:
    """The distinct targets in the order of their best row; a limit of 0 gives none."""
    best = ranked.where("target is not null").groupBy("target").agg(F.max(F.struct("pressure", "age_days", (-F.col(order)).alias("o"))).alias("b"))
    return best.orderBy(F.desc("b")).limit(limit).select("target", F.col("b.pressure").alias("pressure"), F.col("b.age_days").alias("age_days"), (-F.col("b.o")).alias(order))


def stale_stats(df: DataFrame, now: Column, days: float = DEFAULT_DAYS) -> DataFrame:
    age = age_days(F.col("fetched_at"), now)
    target = refresh_id(F.col("versions_url"), F.col("cited_by_url"))
    out = df.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(age.isNull()).alias("undated"), F.min(age).alias("youngest"), F.max(age).alias("oldest"),
        F.count_if(age >= days).alias("stale"), F.count_if((age >= days) & target.isNotNull()).alias("refreshable"),
    )
    return out.withColumn("same_age", F.coalesce(F.col("oldest") - F.col("youngest") < 1, F.lit(False)))


def described() -> Column:
    """A row of :func:`rank_stale` as one line: age, count, how it can be fetched again, title."""
    title = clip(F.coalesce(filled(strip(F.regexp_replace("title", r"(?U:\s)+", " "))), F.lit("untitled")), 70)
    count = F.coalesce(F.format_number("cited_by_count", 0), F.lit("?"))
    how = F.coalesce(F.concat(F.lit("cluster "), "target"), F.lit("no id; run its query again"))
    return F.format_string("%5dd  %9s citations  %-28s  %s", F.bround("age_days", 0).cast("long"), count, how, title)


def refresh_lines(ranked: DataFrame, limit: int, order: str) -> DataFrame:
    """``o`` (what they are ordered by) and ``line`` of a refresh list: what it is, then for each id a comment and the id."""
    ids = refresh_targets(ranked, limit, order).join(ranked.select(order, "title"), order)
    about = clip(F.coalesce(filled(strip(F.regexp_replace("title", r"(?U:\s)+", " "))), F.lit("untitled")), 80)
    said = F.concat(F.lit("# "), F.bround("age_days", 0).cast("long").cast("string"), F.lit(" days old: "), about, F.lit("\n"), F.col("target"))
    place = F.struct((-F.col("pressure")).alias("p"), (-F.col("age_days")).alias("a"), F.col(order).cast("long").alias("k"))
    low = F.struct(F.lit(float("-inf")).alias("p"), F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("k"))
    head = ranked.sparkSession.range(1).select(low.alias("o"), F.lit("# stale records worth listing again, heaviest first").alias("line"))
    return head.unionByName(ids.select(place.alias("o"), said.alias("line")))
