"""Overview, histograms, grouped profiles and top lists.

All groups are hash aggregates that combine before the shuffle; ties go to the
row that came first, by ``order``.  Empty tables give zero counts in the
overview and no rows elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, filled, first_author
from ..functions.venues import normalize_venue

GROUP_KEYS = ("author", "venue", "year", "level")


def cites(count: str = "cited_by_count") -> Column:
    return F.coalesce(F.col(count), F.lit(0))


def group_label(key: str) -> Column:
    """Label of a record along one of :data:`GROUP_KEYS`; null if it has none."""
    if key == "author":
        return first_author(F.col("authors"), F.col("byline"))
    if key == "venue":
        return F.when(~F.coalesce(F.col("citation_only"), F.lit(False)), filled(normalize_venue(filled(F.col("venue")))))
    if key == "year":
        return F.nullif(F.col("year"), F.lit(0)).cast("string")
    if key == "level":
        return F.concat(F.lit("L"), F.coalesce(F.col("extra.follow_depth"), F.lit(0)).cast("string"))
    raise ValueError(f"unknown group key {key!r}; choose from {', '.join(GROUP_KEYS)}")


def overview(df: DataFrame, **more: Column) -> DataFrame:
    """One row: records, citations, with_bibtex, citation_only, unknown_year, venue_count, author_count, and ``more`` aggregates."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(cites()), F.lit(0)).alias("citations"),
        F.count_if(filled(F.col("extra.bibtex_key")).isNotNull()).alias("with_bibtex"),
        F.count_if(F.coalesce(F.col("citation_only"), F.lit(False))).alias("citation_only"),
        F.count_if(F.nullif(F.col("year"), F.lit(0)).isNull()).alias("unknown_year"),
        F.count_distinct(casefold(group_label("venue"))).alias("venue_count"),
        F.count_distinct(casefold(group_label("author"))).alias("author_count"),
        *[c.alias(n) for n, c in more.items()],
    )


def year_histogram(df: DataFrame) -> DataFrame:
    """``year``, ``records``, newest first (no year, and year 0, left out)."""
    return df.where("year is not null and year <> 0").groupBy("year").agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("year"))


def level_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("extra.follow_depth", F.lit(0)).alias("level")).agg(F.count(F.lit(1)).alias("records")).orderBy("level")


def buckets(df: DataFrame, label: Column, order: str) -> DataFrame:
    """``label`` (first spelling seen), ``records``, ``first`` per case-folded label."""
    rows = df.withColumn("__label", label).where(filled(F.col("__label")).isNotNull())
    b = rows.groupBy(casefold(F.col("__label")).alias("fold"))
    return b.agg(F.min_by("__label", order).alias("label"), F.count(F.lit(1)).alias("records"), F.min(order).alias("first"))


def top_venues(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return buckets(df, group_label("venue"), order).select("label", "records").orderBy(F.desc("records"), "label").limit(n)


def most_cited(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(cites()), F.asc(order)).limit(n)


def query_frequency(df: DataFrame, order: str) -> DataFrame:
    rows = df.where("query <> ''").groupBy("query").agg(F.count(F.lit(1)).alias("records"), F.min(order).alias("first"))
    return rows.orderBy(F.desc("records"), "first")


def group_profile(df: DataFrame, label: Column, order: str, count: Column | None = None, year: str = "year", title: str = "title") -> DataFrame:
    """Per case-folded label: first spelling, records, citations, median (truncated), first and last
    year, the best row's title and count; most citations first."""
    count = cites() if count is None else count
    rows = df.select(label.alias("__label"), count.cast("long").alias("__c"), F.nullif(F.col(year), F.lit(0)).alias("__y"), F.col(title).alias("__t"), F.col(order).alias("__o"))
    rows = rows.where(filled(F.col("__label")).isNotNull())
    out = rows.groupBy(casefold(F.col("__label")).alias("fold")).agg(
        F.min_by("__label", "__o").alias("label"), F.count(F.lit(1)).alias("records"), F.sum("__c").alias("citations"), F.percentile("__c", 0.5).cast("bigint").alias("median_citations"),
        F.min("__y").alias("first_year"), F.max("__y").alias("last_year"), F.max_by("__t", F.struct("__c", -F.col("__o"))).alias("best_title"), F.max("__c").alias("best_citations"), F.min("__o").alias("first"),
    )
    return out.drop("fold").orderBy(F.desc("citations"), F.desc("records"), "first")


def shared_title(df: DataFrame, generic: str = "Literature overview") -> DataFrame:
    """The one query all records share, else a generic heading."""
    only = df.agg(F.count_distinct(filled(F.col("query"))).alias("n"), F.max(filled(F.col("query"))).alias("q"))
    return only.select(F.when(F.col("n") == 1, F.coalesce(filled(F.trim("q")), F.lit(generic))).otherwise(generic).alias("title"))
