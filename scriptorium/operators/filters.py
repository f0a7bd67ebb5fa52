"""Filters, caps and conditional checks on pages and requests."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_records(df: DataFrame, min_citations: int = 0, year_low: int | None = None, year_high: int | None = None, count: str = "cited_by_count", year: str = "year") -> DataFrame:
    """Records with enough citations and a year within bounds; a null year is kept only without bounds.

    The count is always compared, so negative counts go even with the default.
    """
    out = df.where(F.coalesce(F.col(count), F.lit(0)) >= min_citations)
    if year_low is not None:
        out = out.where(F.col(year) >= year_low)
    if year_high is not None:
        out = out.where(F.col(year) <= year_high)
    return out


def recent_year_low(recent: int, today: date) -> int:
    """First of the last ``recent`` calendar years, this one included."""
    if recent < 1:
        raise ValueError("recent counts years, so it takes 1 or more")
    return today.year - recent + 1


def resolve_recent(recent: int | None, year_low: int | None, today: date, recent_given: bool = True, year_given: bool = True) -> int | None:
    """The lower year bound of two settings: both together are refused unless exactly one was
    given on the command line, which then holds."""
    if recent is None:
        return year_low
    if year_low is not None:
        if recent_given == year_given:
            raise ValueError("usage: recent and year_low contradict each other")
        if year_given:
            return year_low
    return recent_year_low(recent, today)


def request_fault(query: Column, cites: Column, cluster: Column, low: Column, high: Column) -> Column:
    """Why a search request can't be run, null if it can."""
    none = lambda x: F.coalesce(x, F.lit("")) == ""
    return F.when(none(query) & none(cites) & none(cluster), "no query and no id").when(low > high, "the years are the wrong way round")


def cap_per_target(df: DataFrame, target: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each target, and ``truncated`` where it had more."""
    w = Window.partitionBy(target)
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(order))).where(F.col("__rn") <= cap + 1)
    return ranked.withColumn("truncated", F.max("__rn").over(w) > cap).where(F.col("__rn") <= cap).drop("__rn")


def check_pages(pages: DataFrame, page: list[str], total: str | None = None, has_next: str | None = None) -> DataFrame:
    """The ten self-checks of result pages: ``page`` columns, ``check``, ``ok``, ``passed``, ``of``.

    ``pages`` has one row per record with the record fields; ``total`` and
    ``has_next`` name page-level columns.
    """
    filled = lambda c: F.count_if(F.coalesce(F.col(c).cast("string") != "", F.lit(False)))
    year = F.count_if(F.coalesce(F.col("year") != 0, F.lit(False)))
    linkable = F.coalesce(~F.col("citation_only"), F.lit(True))
    cited = F.coalesce(F.col("cited_by_count") != 0, F.lit(False)) & F.coalesce(F.col("cited_by_url") != "", F.lit(False))
    agg = pages.groupBy(*page).agg(
        F.count(F.lit(1)).alias("n"), filled("title").alias("titles"), F.count_if(linkable).alias("linkable"), F.count_if(linkable & F.coalesce(F.col("link") != "", F.lit(False))).alias("linked"),
        filled("byline").alias("bylines"), year.alias("years"), filled("snippet").alias("snippets"), filled("cluster_id").alias("cards"), F.count_if(cited).alias("cited"),
        (F.max(total) if total else F.lit(None).cast("long")).alias("total"), (F.max(has_next) if has_next else F.lit(None).cast("boolean")).alias("next"),
    )
    c = F.col

    def row(name: str, ok: Column, passed: Column, of: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), passed.cast("long").alias("passed"), of.cast("long").alias("of"))

    some = c("n") > 0
    rows = [
        row("results_parsed", c("n") >= 5, c("n"), c("n")),
        row("titles", some & (c("titles") == c("n")), c("titles"), c("n")),
        row("links", (c("linkable") > 0) & (c("linked") == c("linkable")), c("linked"), c("linkable")),
        row("bylines", some & (c("bylines") == c("n")), c("bylines"), c("n")),
        row("years", some & (c("years") >= c("n") * 0.6), c("years"), c("n")),
        row("snippets", some & (c("snippets") >= c("n") * 0.5), c("snippets"), c("n")),
        row("card_ids", some & (c("cards") == c("n")), c("cards"), c("n")),
        row("citation_counts", c("cited") > 0, c("cited"), c("n")),
    ]
    if total:
        rows.append(row("total_estimate", c("total").isNotNull(), c("total").isNotNull(), F.lit(1)))
    if has_next:
        rows.append(row("pagination", c("next"), c("next"), F.lit(1)))
    return agg.select(*page, F.inline(F.array(*rows)))


#: What the text of a saved page says of a challenge, and markup that shows one.
TEXT_SIGNALS = (
    ("unusual traffic", "rate_limit"), ("异常流量", "rate_limit"), ("automated queries", "rate_limit"), ("i'm not a robot", "captcha"),
    ("我不是机器人", "captcha"), ("type the characters", "captcha"), ("before you continue", "consent"), ("继续前往", "consent"),
)
MARKUP_SIGNALS = (r"""id=["'](gs_captcha_ccl|gs_captcha_f|captcha-form)["']""", r"""<iframe[^>]+src=["'][^"']*recaptcha""", r"""class=["'][^"']*g-recaptcha""")
RESULT_MARKUP = r"""class=["'][^"']*(gs_r\b[^"']*gs_scl|gs_med)|id=["'](gs_res_ccl_mid|gsc_a_b|gsc_prf_in)["']"""


def classify_challenge(url: Column, html: Column) -> Column:
    """Kind of challenge a saved page shows, null for ordinary content."""
    body = F.lower(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<[^>]+>", " "))
    out = F.when(url.contains("/sorry/") | url.contains("sorry/index"), "captcha").when(url.rlike(r"^https://consent\."), "consent").when(url.rlike(r"^https?://accounts\."), "sign_in")
    for m in MARKUP_SIGNALS:
        out = out.when(html.rlike(m), "captcha")
    out = out.when(html.rlike(RESULT_MARKUP), None)
    for needle, kind in TEXT_SIGNALS:
        out = out.when(body.contains(needle), kind)
    return out


#: What an error text says, first match first.
ERROR_SIGNALS = (
    ("ERR_CONNECTION_REFUSED", "connection_refused"), ("ERR_UNSAFE_PORT", "connection_refused"), ("ERR_NAME_NOT_RESOLVED", "dns"), ("ERR_NAME_RESOLUTION_FAILED", "dns"),
    ("ERR_INTERNET_DISCONNECTED", "offline"), ("ERR_NETWORK_CHANGED", "offline"), ("ERR_PROXY_CONNECTION_FAILED", "proxy"), ("ERR_TUNNEL_CONNECTION_FAILED", "proxy"),
    ("ERR_CONNECTION_RESET", "reset"), ("ERR_CONNECTION_CLOSED", "reset"), ("ERR_EMPTY_RESPONSE", "reset"), ("ERR_CONNECTION_TIMED_OUT", "timeout"),
    ("ERR_CERT_", "certificate"), ("SSL_", "certificate"), ("Timeout", "timeout"), ("has been closed", "browser_closed"), ("Target closed", "browser_closed"),
)


def classify_error(message: Column) -> Column:
    """Class of a logged error text, ``unknown`` if no signal matches."""
    out = F.when(message.isNull(), F.lit("unknown"))
    for needle, kind in ERROR_SIGNALS:
        out = out.when(message.contains(needle), kind)
    return out.otherwise("unknown")
