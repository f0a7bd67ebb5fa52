"""Data-quality audit: a registry of declarative checks, counted in one scan.

Every check is a Column predicate; users may pass their own.  One projection
tags each record with the checks it trips, and one partial aggregation counts
them.  The clock is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, filled, strip

ALARM_SHARE, ALARM_RECORDS, EARLIEST_YEAR = 0.2, 3, 1800
#: Fixed formats.
PAGES_ONLY = r"^[\d\s\-–—,():.]+$"
VOLUME_ISSUE = r"^\d+\s*\(\d*\)"
HOSTNAME = r"(?i)^[\w.-]+\.(com|org|edu|net|gov|io|cn|uk|de)$"
YEAR_TOKEN = r"(?U:\b)(1[89]\d{2}|20\d{2})(?U:\b)"
MARK_BEGIN, MARK_END = r"^(…|\.\.\.)", r"(…|\.\.\.)$"


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    explain: str
    applies: Column


def _t(name: str) -> Column:
    return F.coalesce(strip(F.col(name)), F.lit(""))


def checks(this_year: int) -> list[Check]:
    """The fifteen checks of bibliographic records, in report order."""
    c, venue, byline = F.col, _t("venue"), _t("byline")
    years = F.regexp_extract_all(byline, F.lit(YEAR_TOKEN), F.lit(1))
    no = F.lit(False)
    return [
        Check("title_missing", "error", "no title; the record cannot be used", _t("title") == ""),
        Check("title_tagged", "warn", "a tag such as [PDF] is left in the title", _t("title").startswith("[")),
        Check("year_out_of_range", "error", "the year is no plausible publication year", F.coalesce((c("year") < EARLIEST_YEAR) | (c("year") > this_year + 1), no)),
        Check("year_disagrees_with_byline", "error", "the byline names other years than the stored one", F.coalesce((F.size(years) > 0) & c("year").isNotNull() & ~F.array_contains(years, c("year").cast("string")), no)),
        Check("year_missing", "warn", "no year", c("year").isNull()),
        Check("venue_looks_like_pages", "error", "the venue is a page range or an issue number", (venue != "") & (venue.rlike(PAGES_ONLY) | venue.rlike(VOLUME_ISSUE))),
        Check("venue_keeps_year", "error", "the year is left in the venue", venue.rlike(YEAR_TOKEN)),
        Check("venue_is_hostname", "warn", "the venue is a site, not a journal", venue.rlike(HOSTNAME)),
        Check("venue_truncated", "warn", "the venue was cut", venue.rlike(MARK_BEGIN) | venue.rlike(MARK_END)),
        Check("venue_missing", "warn", "no venue", venue == ""),
        Check("authors_missing", "warn", "no authors", _t("authors") == ""),
        Check("authors_truncated", "warn", "the author list was cut", _t("authors").rlike(MARK_END)),
        Check("citations_without_link", "error", "a citation count without the link to the citing works", F.coalesce(c("cited_by_count") != 0, no) & (filled(c("cited_by_url")).isNull())),
        Check("negative_count", "error", "a count below zero", F.coalesce(c("cited_by_count") < 0, no) | F.coalesce(c("versions_count") < 0, no)),
        Check(
            "cluster_id_missing", "warn", "no id to follow or refresh the work by",
            filled(c("cluster_id")).isNull() & ~F.coalesce(c("citation_only"), no) & filled(c("extra.citation_id")).isNull(),
        ),
    ]


def _tripped(df: DataFrame, registry: list[Check], *keep: Column) -> DataFrame:
    tags = F.array(*[F.when(k.applies, F.lit(i)) for i, k in enumerate(registry)])
    return df.select(*keep, F.explode(F.array_compact(tags)).alias("idx"))


def audit_counts(df: DataFrame, registry: list[Check]) -> DataFrame:
    """``check``, ``severity``, ``count``, ``total``, ``share``: errors first, most frequent first.

    One aggregate over the records with one conditional count per check.
    """
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(k.applies).alias(f"c{i}") for i, k in enumerate(registry)])
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(k.name).alias("check"), F.lit(k.severity).alias("severity"), F.col(f"c{i}").alias("count")) for i, k in enumerate(registry)])
    out = one.select("total", F.inline(rows)).where("count > 0")
    out = out.withColumn("share", F.col("count") / F.col("total"))
    return out.orderBy(F.col("severity") != "error", F.desc("count"), "idx").select("check", "severity", "count", "total", "share")


def audit_examples(df: DataFrame, registry: list[Check], order: str, n: int = 2) -> DataFrame:
    """The first ``n`` offending records of each check: ``check``, ``place``, ``value``, ``title``.

    The value is the field named by the first word of the check, where there is one.
    Rows are cut to ``n`` per check within each partition before the shuffle.
    """
    columns = set(df.columns)
    value = F.coalesce(*[F.when(F.col("idx") == i, F.col(f) if (f := k.name.split("_")[0]) in columns else F.lit(None)).cast("string") for i, k in enumerate(registry)])
    rows = _tripped(df, registry, *[F.col(f"`{c}`") for c in df.columns])
    w = Window.partitionBy("idx").orderBy(order)
    top = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    names = F.array(*[F.lit(k.name) for k in registry])
    return top.select(F.get(names, F.col("idx")).alias("check"), "place", F.coalesce(clip(filled(value), 60), F.lit("<empty>")).alias("value"), F.coalesce(clip(filled(F.col("title")), 52), F.lit("<empty>")).alias("title"))


def audit_alarms(counts: DataFrame, share: float = ALARM_SHARE, least: int = ALARM_RECORDS) -> DataFrame:
    """The errors frequent enough to stop for."""
    return counts.where((F.col("severity") == "error") & (F.col("count") >= least) & (F.col("share") >= share))
