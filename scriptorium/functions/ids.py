"""Identities, ids in URLs, and request signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, strip


def work_key(cluster_id: Column, title: Column, link: Column) -> Column:
    """Identity of a work: its cluster id, else title and link (a null title reads ``None``)."""
    return F.coalesce(filled(cluster_id), F.concat(F.coalesce(title, F.lit("None")), F.lit("::"), F.coalesce(filled(link), F.lit(""))))


def parse_id(value: Column) -> Column:
    """A numeric id, bare or after ``cites=`` / ``cluster=`` in a URL; null if there is none."""
    t = strip(value)
    return F.when(t.rlike(r"^\d+$"), t).otherwise(filled(F.regexp_extract(t, r"(?:cites|cluster)=(\d+)", 1)))


def parse_user(value: Column) -> Column:
    """A profile id of 12 characters, bare or after ``user=``; null if there is none."""
    t = strip(value)
    return F.when(t.rlike(r"^[\w-]{12}$"), t).otherwise(filled(F.regexp_extract(t, r"user=([\w-]{12})", 1)))


def cited_target(query: Column) -> Column:
    """The id a record was found as citing, from provenance ``cites:<id>``; null otherwise."""
    return F.when(query.startswith("cites:"), filled(F.substring(query, 7, 1_000)))


def refresh_id(versions_url: Column, cited_by_url: Column) -> Column:
    return F.coalesce(parse_id(versions_url), parse_id(cited_by_url))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def search_signature(query, cites, cluster, low, high, language, by_date, citations, patents, reviews) -> Column:
    """Canonical key of a search request: equal requests share it."""
    fields = (("cites", cites), ("cluster", cluster), ("lo", low), ("hi", high), ("lang", language))
    flags = (("date", by_date), ("cit", citations), ("pat", patents), ("rev", reviews))
    return F.concat_ws(
        "|", _text(query), *[F.concat(F.lit(f"{k}="), _text(v)) for k, v in fields], *[F.concat(F.lit(f"{k}="), F.when(v, "1").otherwise("0")) for k, v in flags]
    )


def author_signature(user_id: Column, language: Column, by_year: Column) -> Column:
    return F.concat_ws("|", F.concat(F.lit("author="), user_id), F.concat(F.lit("lang="), _text(language)), F.concat(F.lit("year="), F.when(by_year, "1").otherwise("0")))


SEARCH = r"(?s)^(.*)\|cites=([^|]*)\|cluster=([^|]*)\|lo=([^|]*)\|hi=([^|]*)\|lang=([^|]*)\|date=([^|]*)\|cit=([^|]*)\|pat=([^|]*)\|rev=([^|]*)$"
AUTHOR = r"^author=([^|]*)\|lang=([^|]*)\|year=([^|]*)$"


def parse_signature(signature: Column) -> Column:
    """STRUCT of the request a signature stands for; null for neither layout, a year that is
    no number, or a search without query and ids.  A query may hold ``|``."""
    g = lambda k: filled(F.regexp_extract(signature, SEARCH, k))
    a = lambda k: filled(F.regexp_extract(signature, AUTHOR, k))
    search = signature.rlike(SEARCH) & ~signature.startswith("author=")
    number = lambda c: c.isNull() | c.rlike(r"^\s*-?\d{1,9}\s*$")
    valid = search & F.coalesce(g(1), g(2), g(3)).isNotNull() & number(g(4)) & number(g(5))
    none = F.lit(None).cast("string")

    def row(kind, user, query, cites, cluster, low, high, lang, by_date, cit, pat, rev) -> Column:
        names = ("kind", "user_id", "query", "cites", "cluster", "year_low", "year_high", "language", "sorted", "citations", "patents", "reviews")
        return F.struct(*[c.alias(n) for n, c in zip(names, (kind, user, query, cites, cluster, low, high, lang, by_date, cit, pat, rev), strict=True)])

    year = lambda c: F.trim(c).try_cast("bigint")
    flag = lambda c: F.coalesce(c == "1", F.lit(False))
    nothing, no = F.lit(None).cast("bigint"), F.lit(None).cast("boolean")
    return F.when(signature.rlike(AUTHOR), row(F.lit("author"), F.coalesce(a(1), F.lit("")), none, none, none, nothing, nothing, a(2), flag(a(3)), no, no, no)).when(
        valid, row(F.lit("search"), none, F.coalesce(g(1), F.lit("")), g(2), g(3), year(g(4)), year(g(5)), g(6), flag(g(7)), flag(g(8)), flag(g(9)), flag(g(10)))
    )


def describe_signature(signature: Column) -> Column:
    """A readable name of the request behind a signature; the signature itself if it is none."""
    r = parse_signature(signature)
    label = F.when(r["kind"] == "author", F.concat(F.lit("author:"), r["user_id"])).otherwise(
        F.coalesce(filled(r["query"]), F.concat(F.lit("cites:"), r["cites"]), F.concat(F.lit("cluster:"), r["cluster"]))
    )
    years = F.regexp_replace(F.concat(_text(F.nullif(r["year_low"], F.lit(0))), F.lit("-"), _text(F.nullif(r["year_high"], F.lit(0)))), "^-+|-+$", "")
    said = F.when(r["kind"] == "author", F.array(_text(r["language"]), F.when(r["sorted"], "by year").otherwise(""))).otherwise(
        F.array(
            _text(r["language"]), years, F.when(r["sorted"], "by date").otherwise(""), F.when(~r["citations"], "no citations").otherwise(""),
            F.when(~r["patents"], "no patents").otherwise(""), F.when(r["reviews"], "reviews only").otherwise(""),
        )
    )
    kept = F.filter(said, lambda x: x != "")
    return F.when(r.isNull(), signature).otherwise(F.concat(label, F.when(F.size(kept) > 0, F.concat(F.lit(" ["), F.array_join(kept, ", "), F.lit("]"))).otherwise("")))
