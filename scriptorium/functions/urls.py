"""URLs built, resolved and redacted with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled

#: Parameters whose values stay readable, and the path below which only one does.
READABLE = ("q", "start", "cites", "cluster", "user", "hl", "as_sdt", "as_ylo", "as_yhi", "cstart", "pagesize")
CHALLENGE_PATH, CHALLENGE_READABLE = "/sorry", ("hl",)
PER_PAGE, PER_PROFILE_PAGE = 10, 100


def quote(c: Column) -> Column:
    """Form encoding: space as ``+``; ``~`` stays, ``*`` is encoded."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query(pairs: list[tuple[str, Column]]) -> Column:
    """``k=v`` joined by ``&``; pairs with a null value are left out."""
    return F.concat_ws("&", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), quote(v.cast("string")))) for k, v in pairs])


def _set(c: Column) -> Column:
    return filled(c.cast("string"))


def search_url(host: Column, query, cites, cluster, start, low, high, language, by_date, citations, patents, reviews) -> Column:
    """URL of a result page; empty parameters are left out, the last two are always there."""
    pairs = [
        ("hl", F.coalesce(_set(language), F.lit("en"))), ("cites", _set(cites)), ("cluster", _set(cluster)), ("q", _set(query)),
        ("start", F.nullif(start, F.lit(0))), ("as_ylo", low), ("as_yhi", high), ("scisbd", F.when(by_date, 1)), ("as_rr", F.when(reviews, 1)),
        ("as_vis", F.when(citations, 0).otherwise(1)), ("as_sdt", F.when(patents, "0,5").otherwise("0")),
    ]
    return F.concat(host, F.lit("/scholar?"), _query(pairs))


def author_url(host: Column, user_id: Column, language: Column, cstart: Column, by_year: Column, page_size: int = PER_PROFILE_PAGE) -> Column:
    pairs = [("user", user_id), ("hl", F.coalesce(_set(language), F.lit("en"))), ("cstart", cstart), ("pagesize", F.lit(page_size)), ("sortby", F.when(by_year, "pubdate"))]
    return F.concat(host, F.lit("/citations?"), _query(pairs))


def cite_url(host: Column, cluster_id: Column, site: str, language: Column | None = None) -> Column:
    """URL of the citation popup; ``site`` is the host name the id is qualified with."""
    pairs = [("q", F.concat(F.lit("info:"), cluster_id, F.lit(f":{site}/"))), ("output", F.lit("cite")), ("scirp", F.lit(0)), ("hl", F.lit("en") if language is None else F.coalesce(_set(language), F.lit("en")))]
    return F.concat(host, F.lit("/scholar?"), _query(pairs))


def absolute(href: Column, host: Column) -> Column:
    """An href made absolute; null for null or empty."""
    return (
        F.when(filled(href).isNull(), None)
        .when(href.startswith("http://") | href.startswith("https://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .otherwise(F.concat(host, F.when(href.startswith("/"), "").otherwise("/"), href))
    )


def redact_url(url: Column) -> Column:
    """The URL with the values of unknown parameters replaced, and without fragment; a URL
    without query is returned as it is."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    path = F.regexp_extract(bare, r"^(?:\w[\w+.-]*:)?(?://[^/?]*)?([^?]*)", 1)
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    name = lambda x: decode(F.substring_index(x, "=", 1))
    value = lambda x: decode(F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).otherwise(""))
    readable = lambda n: F.when(path.startswith(CHALLENGE_PATH), n.isin(*CHALLENGE_READABLE)).otherwise(n.isin(*READABLE))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(quote(name(x)), F.lit("="), quote(F.when(readable(name(x)), value(x)).otherwise("REDACTED"))))
    return F.when(query == "", url).otherwise(F.concat(F.substring_index(bare, "?", 1), F.lit("?"), F.array_join(pairs, "&")))
