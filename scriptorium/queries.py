"""Queries of the record operators over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema, streaming
from .functions import biblio as bx
from .functions import ids, urls
from .functions import text as tx
from .functions import venues as vx
from .operators import audit, biblio, delta, filters, graph, merge, planning, stale, summary
from .plans import digest
from .plans.report import build_report
from .session import checkpoint_dir
from .sources import html, jsonl, sinks, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOST, SITE, NOW, YEAR, CUT = "https://index.example", "index.example", "2026-09-02T12:00:00", 2026, "'2025-01-01'"
KEY_SQL = "coalesce(nullif(cluster_id, ''), coalesce(title, 'None') || '::' || coalesce(nullif(link, ''), ''))"
#: Instant of ``fetched_at`` in DuckDB, as seconds.
AT_SQL = r"""(case when regexp_matches(fetched_at, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}')
  then cast(epoch(try_cast(substr(fetched_at, 1, 10) || ' ' || substr(fetched_at, 12, 8) as timestamp)) as bigint)
    - case when regexp_matches(fetched_at, '[+-]\d{2}:\d{2}$') then (case when substr(fetched_at, -6, 1) = '-' then -1 else 1 end)
      * (cast(substr(fetched_at, -5, 2) as bigint) * 3600 + cast(substr(fetched_at, -2, 2) as bigint) * 60) else 0 end end)"""


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def results(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "scholar_results")


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("work_key", ids.work_key(F.col("cluster_id"), F.col("title"), F.col("link")))


c = F.col

# ---- scans and repair


def messy_lines(df: DataFrame) -> DataFrame:
    """Records as JSON lines with wrong kinds, broken lines and lists put in where fields are odd."""
    js = lambda e: F.to_json(F.struct(e.alias("x")), {"ignoreNullFields": "false"})
    inner = lambda e: F.regexp_extract(js(e), r'(?s)^\{"x":(.*)\}$', 1)
    year = F.when(c("venue") == "-", F.lit('"soon"')).when(c("link").isNull(), F.concat(F.lit('" '), c("year").cast("string"), F.lit('"'))).otherwise(c("year").cast("string"))
    count = F.when(c("citation_only"), F.concat(c("cited_by_count").cast("string"), F.lit(".5"))).otherwise(c("cited_by_count").cast("string"))
    authors = F.when(c("link").isNull() & c("authors").isNotNull(), F.concat(F.lit("["), inner(c("authors")), F.lit(', "K Lee"]'))).otherwise(inner(c("authors")))
    flag = F.when(c("year").isNull(), F.lit('"no"')).otherwise(c("citation_only").cast("string"))
    n = lambda e: F.coalesce(e, F.lit("null"))
    odd = ("year", "cited_by_count", "authors", "citation_only")
    rest = F.regexp_extract(F.to_json(F.struct(*[c(f.name) for f in schema.RECORD.fields if f.name not in odd]), {"ignoreNullFields": "false"}), r"(?s)^\{(.*)\}$", 1)
    line = F.concat(F.lit('{"year": '), n(year), F.lit(', "cited_by_count": '), n(count), F.lit(', "authors": '), n(authors), F.lit(', "citation_only": '), n(flag), F.lit(', "other": [1, {"a": 2}], '), rest, F.lit("}"))
    value = F.when(c("query") == "", "{oops").when(c("title") == "", "[1, 2]").otherwise(line)
    return df.select(c("obs_id").alias("ord"), value.alias("value"))


MESSY = """
m as (select *, query is not null and query = '' or title is not null and title = '' as malformed, link is null as nolink,
  case when venue = '-' then null else year end as y, case when not coalesce(citation_only, false) then cited_by_count end as n,
  case when link is null and authors is not null then authors || ', K Lee' else authors end as a, case when year is not null then citation_only end as f,
  (venue is not null and venue = '-') or (link is null and year is not null) or (coalesce(citation_only, false) and cited_by_count is not null)
    or (link is null and authors is not null) or year is null as repaired
  from scholar_results)
"""


_EVEN = [f.name for f in schema.RECORD.fields if f.name not in ("year", "cited_by_count", "authors", "citation_only", "extra")]
_PARTS = ("follow_depth", "bibtex_key", "citation_id")


@query(
    f"with {MESSY} select obs_id as ord, case when not malformed then y end as year, case when not malformed then n end as cited_by_count, case when not malformed then a end as authors, "
    "case when not malformed then f end as citation_only, malformed, repaired and not malformed as repaired, " + ", ".join(f"case when not malformed then {x} end as {x}" for x in _EVEN)
    + ", " + ", ".join(f"case when not malformed then extra.{x} end as {x}" for x in _PARTS) + ", case when not malformed then 'other' end as more from m"
)
def lenient_scan(spark, sf):
    rows = jsonl.parse_lines(messy_lines(results(spark, sf)))
    return rows.select("ord", "year", "cited_by_count", "authors", "citation_only", "malformed", "repaired", *_EVEN, *[c(f"extra.{x}").alias(x) for x in _PARTS], F.array_join(F.map_keys(schema.REST), ",").alias("more"))


@query(f"with {MESSY} select count_if(not malformed) as records, count_if(malformed) as unreadable_lines, count_if(repaired and not malformed) as repaired_records from m")
def scan_counts(spark, sf):
    return jsonl.scan_counts(jsonl.parse_lines(messy_lines(results(spark, sf))))


_PLACED = "cast(substr(o_orderpriority, 1, 1) as int)"


@query(
    f"with o as (select o_orderkey as k, {_PLACED} as p, o_orderstatus as s from orders) select k, case when p = 1 and s <> 'O' then k when p = 2 then -k when p = 5 then -k end as n, case when p = 4 then s = 'O' end as flag, "
    "case when p = 1 and s <> 'O' then ' ' || k || ' ' when p = 1 then k || ' x' when p = 5 then '-' || k when p = 4 then null when p = 3 and s = 'O' then k || ', None, b' end as text, case when p = 2 then -k when p = 3 and s <> 'O' then k + 0.5 end as real from o"
)
def repair_number(spark, sf):
    """Every kind of value, after the order's priority and status."""
    from .functions import repair

    k, p, s = c("o_orderkey").cast("string"), F.substring("o_orderpriority", 1, 1), c("o_orderstatus")
    quoted = lambda *x: F.concat(F.lit('"'), *x, F.lit('"'))
    json = F.when((p == "1") & (s != "O"), quoted(F.lit(" "), k, F.lit(" "))).when(p == "1", quoted(k, F.lit(" x"))).when(p == "2", F.concat(F.lit("-"), k)).when((p == "3") & (s == "O"), F.concat(F.lit("["), quoted(k), F.lit(', null, "b"]')))
    json = json.when(p == "3", F.concat(k, F.lit(".5"))).when(p == "4", F.when(s == "O", "true").otherwise("false")).otherwise(quoted(F.lit("-"), k))
    v = read(spark, sf, "orders").select(c("o_orderkey").alias("k"), F.try_parse_json(json).alias("v"))
    return v.select("k", repair.as_number(c("v")).alias("n"), repair.as_flag(c("v")).alias("flag"), repair.as_text(c("v")).alias("text"), repair.as_double(c("v")).alias("real"))


@query(f"select obs_id, {KEY_SQL} as work_key from scholar_results")
def work_keys(spark, sf):
    return keyed(results(spark, sf)).select("obs_id", "work_key")


@query("select trim(query) as item, count(*) as n from scholar_results where trim(query) <> '' and trim(query) not like '#%' group by all")
def list_items(spark, sf):
    return jsonl.list_items(results(spark, sf), "query").groupBy(c("query").alias("item")).agg(F.count(F.lit(1)).alias("n"))


# ---- merge

MERGED = ["title", "link", "authors", "venue", "year", "snippet", "cited_by_count", "versions_count", "versions_url"]
_PLAIN = {"year", "cited_by_count", "versions_count", "position", "page_start", "citation_only"}


def _merge_sql(fields: list[str], parts: tuple[str, ...] = ()) -> str:
    """The left fold itself, over lists in order of arrival; ``parts`` of ``extra`` fill each other but don't count."""
    quote = lambda f: f if f in _PLAIN else f"nullif({f}, '')"
    one = lambda x, f: f"{x}.{f}" if f in _PLAIN or f in parts else f"nullif({x}.{f}, '')"
    filled = lambda x: " + ".join(f"(case when {one(x, f)} is not null then 1 else 0 end)" for f in fields)
    rank = lambda x: f"(coalesce(nullif({x}.cited_by_count, 0), -1) * 100 + {filled(x)})"
    pick = lambda win, lose: "struct_pack(" + ", ".join(f"{f} := coalesce({one(win, f)}, {one(lose, f)})" for f in (*fields, *parts)) + ")"
    packed = ", ".join([*(f"{f} := {f}" for f in fields), *(f"{x} := extra.{x}" for x in parts)])
    return f"""with k as (select {KEY_SQL} as work_key, * from scholar_results),
g as (select work_key, min(obs_id) as obs_id, count(*) as n_rows, list(struct_pack({packed}) order by obs_id) as l from k group by all),
r as (select work_key, obs_id, n_rows, list_reduce(l, lambda a, x: case when {rank('x')} > {rank('a')} then {pick('x', 'a')} else {pick('a', 'x')} end) as m from g),
u as (select work_key, obs_id, n_rows, {', '.join(f'm.{f} as {f}' for f in (*fields, *parts))} from r)
select work_key, obs_id, n_rows, {', '.join([*(f'{quote(f)} as {f}' for f in fields), *parts])} from u"""


_MERGE_SQL = _merge_sql(MERGED)


@query(_MERGE_SQL)
def merge_richest(spark, sf):
    return merge.merge_richest(keyed(results(spark, sf)), "work_key", "obs_id", "cited_by_count", MERGED)


@query(f"select {KEY_SQL} as work_key, max(obs_id) as obs_id, arg_max(struct_pack(t := title), obs_id).t as title from scholar_results group by all")
def merge_last(spark, sf):
    return stores.last_per_key(keyed(results(spark, sf)).select("work_key", "obs_id", "title"), "work_key", "obs_id")


@query(f"select {KEY_SQL} as work_key, min(obs_id) as obs_id, arg_min(struct_pack(t := title), obs_id).t as title from scholar_results group by all")
def merge_first(spark, sf):
    return stores.first_per_key(keyed(results(spark, sf)).select("work_key", "obs_id", "title"), "work_key", "obs_id")


@query(f"select count(*) as read, count(distinct {KEY_SQL}) as merged, count(*) - count(distinct {KEY_SQL}) as duplicates from scholar_results")
def merge_counts(spark, sf):
    k = keyed(results(spark, sf)).groupBy("work_key").agg(F.count(F.lit(1)).alias("n"))
    out = k.agg(F.sum("n").alias("read"), F.count(F.lit(1)).alias("merged"))
    return out.withColumn("duplicates", c("read") - c("merged"))


# ---- filters and page checks


@query("select obs_id from scholar_results where coalesce(cited_by_count, 0) >= 5 and year between 2000 and 2020")
def filter_records(spark, sf):
    return filters.filter_records(results(spark, sf), 5, 2000, 2020).select("obs_id")


@query("select obs_id from scholar_results where coalesce(cited_by_count, 0) >= 0")
def filter_default(spark, sf):
    return filters.filter_records(results(spark, sf)).select("obs_id")


@query("select obs_id from scholar_results where coalesce(cited_by_count, 0) >= 0 and year >= 2024")
def filter_recent(spark, sf):
    return filters.filter_records(results(spark, sf), 0, filters.recent_year_low(3, date(2026, 9, 2))).select("obs_id")


@query(
    "with r as (select query, obs_id, row_number() over (partition by query order by obs_id) as n, count(*) over (partition by query) as m from scholar_results where query <> '') "
    "select query, obs_id, m > 20 as truncated from r where n <= 20"
)
def cap_per_target(spark, sf):
    return filters.cap_per_target(results(spark, sf).where("query <> ''").select("query", "obs_id"), "query", "obs_id", 20)


_CHECKS_SQL = """
with a as (select query, page_start, count(*) as n, count_if(coalesce(title <> '', false)) as t, count_if(coalesce(not coalesce(citation_only, false), false)) as la, count_if(coalesce(not coalesce(citation_only, false) and link <> '', false)) as lk,
  count_if(coalesce(byline <> '', false)) as b, count_if(coalesce(year <> 0, false)) as y, count_if(coalesce(snippet <> '', false)) as s, count_if(coalesce(cluster_id <> '', false)) as d, count_if(coalesce(cited_by_count <> 0 and cited_by_url <> '', false)) as ct, max(versions_count) as te, bool_or(citation_only) as nx
  from scholar_results group by all)
select query, page_start, 'results_parsed' as check, n >= 5 as ok, n as passed, n as "of" from a union all select query, page_start, 'titles', t = n, t, n from a
union all select query, page_start, 'links', la > 0 and la = lk, lk, la from a union all select query, page_start, 'bylines', b = n, b, n from a
union all select query, page_start, 'years', y >= n * 0.6, y, n from a union all select query, page_start, 'snippets', s >= n * 0.5, s, n from a
union all select query, page_start, 'card_ids', d = n, d, n from a union all select query, page_start, 'citation_counts', ct > 0, ct, n from a
union all select query, page_start, 'total_estimate', te is not null, case when te is not null then 1 else 0 end, 1 from a union all select query, page_start, 'pagination', coalesce(nx, false), case when nx then 1 when not nx then 0 end, 1 from a
"""


@query(_CHECKS_SQL.replace("as check", 'as "check"'))
def page_checks(spark, sf):
    return filters.check_pages(results(spark, sf), ["query", "page_start"], total="versions_count", has_next="citation_only")


# ---- summaries

_STRIP = lambda e: f"regexp_replace({e}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"
_EDGE = lambda e: f"regexp_replace({e}, '^[ ,.]+|[ ,.]+$', '', 'g')"
_TAIL = r"\s+(\d+)(?:\s*\(([^)]*)\))?(?:,\s*(\d+\s*[-–]\s*\d+|\d+))?(?:,\s*((?:19|20)\d{2}))?\s*$"
_VENUE = f"""
v0 as (select *, {_STRIP('venue')} as t from scholar_results),
v1 as (select *, {_EDGE("regexp_replace(regexp_replace(t, '^…|…$', '', 'g'), '^[.][.][.]|[.][.][.]$', '', 'g')")} as cleaned,
  starts_with(t, '…') or starts_with(t, '...') as cut_head, ends_with(t, '…') or ends_with(t, '...') as cut_tail from v0),
v2 as (select *, coalesce(nullif({_EDGE(f"regexp_replace(cleaned, '{_TAIL}', '')")}, ''), cleaned) as name from v1),
v as (select *, case when venue is null then null when regexp_matches(name, '(?i)^arxiv preprint\\b') then 'arXiv preprint'
  when name = '' then case when cut_head or cut_tail then '…' else '' end
  else (case when cut_head then '… ' else '' end) || name || (case when cut_tail then ' …' else '' end) end as label from v2)
"""
_FIRST = f"nullif({_STRIP(f'''regexp_replace({_STRIP('''split_part(split_part(coalesce(nullif(authors, ''), byline), ' - ', 1), ',', 1)''')}, '^…+|…+$', '', 'g')''')}, '')"
_VLABEL = "case when not coalesce(citation_only, false) and venue <> '' then nullif(label, '') end"


@query(
    f"with {_VENUE} select count(*) as records, coalesce(sum(coalesce(cited_by_count, 0)), 0) as citations, count_if(extra.bibtex_key <> '') as with_bibtex, count_if(coalesce(citation_only, false)) as citation_only, "
    f"count_if(year is null or year = 0) as unknown_year, count(distinct lower({_VLABEL})) as venue_count, count(distinct lower({_FIRST})) as author_count from v"
)
def overview(spark, sf):
    return summary.overview(results(spark, sf))


@query("select year, count(*) as records from scholar_results where year <> 0 group by all")
def year_histogram(spark, sf):
    return summary.year_histogram(results(spark, sf))


@query("select coalesce(extra.follow_depth, 0) as level, count(*) as records from scholar_results group by all")
def level_histogram(spark, sf):
    return summary.level_histogram(results(spark, sf))


@query(f"with {_VENUE}, l as (select obs_id, {_VLABEL} as x from v), b as (select arg_min(x, obs_id) as label, count(*) as records from l where x is not null group by lower(x)) select label, records from b order by records desc, label limit 5")
def top_venues(spark, sf):
    return summary.top_venues(results(spark, sf), "obs_id")


@query("select obs_id, coalesce(cited_by_count, 0) as citations from scholar_results order by citations desc, obs_id limit 10")
def most_cited(spark, sf):
    return summary.most_cited(results(spark, sf), "obs_id", 10).select("obs_id", summary.cites().alias("citations"))


@query("select query, count(*) as records, min(obs_id) as first from scholar_results where query <> '' group by all")
def query_frequency(spark, sf):
    return summary.query_frequency(results(spark, sf), "obs_id")


@query(f"with l as (select obs_id, {_FIRST} as x from scholar_results) select lower(x) as fold, arg_min(x, obs_id) as label, count(*) as records, min(obs_id) as first from l where x is not null group by 1")
def buckets_author(spark, sf):
    return summary.buckets(results(spark, sf), summary.group_label("author"), "obs_id")


def _profile_sql(label: str, source: str = "scholar_results", with_: str = "") -> str:
    return f"""with {with_ + ', ' if with_ else ''}l as (select obs_id, {label} as x, coalesce(cited_by_count, 0) as n, nullif(year, 0) as y, title from {source})
select arg_min(x, obs_id) as label, count(*) as records, cast(sum(n) as bigint) as citations, cast(trunc(median(n)) as bigint) as median_citations, min(y) as first_year, max(y) as last_year,
  arg_max(struct_pack(t := title), struct_pack(n := n, o := -obs_id)).t as best_title, max(n) as best_citations, min(obs_id) as first from l where x is not null group by lower(x)"""


def _profile(key: str, sql: str) -> None:
    def f(spark, sf):
        return summary.group_profile(results(spark, sf), summary.group_label(key), "obs_id")

    f.__name__ = f"group_profile_{key}"
    query(sql)(f)


_profile("author", _profile_sql(_FIRST))
_profile("venue", _profile_sql(_VLABEL, "v", _VENUE))
_profile("year", _profile_sql("cast(nullif(year, 0) as varchar)"))
_profile("level", _profile_sql("'L' || cast(coalesce(extra.follow_depth, 0) as varchar)"))


@query(
    "select n_name as label, count(*) as records, cast(sum(cast(trunc(o_totalprice) as bigint)) as bigint) as citations, cast(trunc(median(cast(trunc(o_totalprice) as bigint))) as bigint) as median_citations, "
    "min(year(o_orderdate)) as first_year, max(year(o_orderdate)) as last_year, max(cast(trunc(o_totalprice) as bigint)) as best_citations from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all"
)
def group_profile_nation(spark, sf):
    o, cu, n = (read(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(cu, o["o_custkey"] == cu["c_custkey"]).join(n, cu["c_nationkey"] == n["n_nationkey"]).select("n_name", "o_orderkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").cast("long").alias("year"))
    p = summary.group_profile(j, c("n_name"), "o_orderkey", F.floor("o_totalprice"), "year", "o_orderpriority")
    return p.select("label", "records", "citations", "median_citations", "first_year", "last_year", "best_citations")


@query("select case when count(distinct nullif(query, '')) = 1 then max(query) else 'Literature overview' end as title from scholar_results")
def shared_title(spark, sf):
    return summary.shared_title(results(spark, sf))


# ---- audit

_T = lambda f: f"coalesce({_STRIP(f)}, '')"
_YT = r"\b(1[89]\d{2}|20\d{2})\b"
_AUDIT = [
    ("title_missing", "error", f"{_T('title')} = ''"), ("title_tagged", "warn", f"starts_with({_T('title')}, '[')"), ("year_out_of_range", "error", f"coalesce(year < 1800 or year > {YEAR + 1}, false)"),
    ("year_disagrees_with_byline", "error", f"year is not null and len(regexp_extract_all({_T('byline')}, '{_YT}')) > 0 and not list_contains(regexp_extract_all({_T('byline')}, '{_YT}'), cast(year as varchar))"),
    ("year_missing", "warn", "year is null"), ("venue_looks_like_pages", "error", f"{_T('venue')} <> '' and (regexp_matches({_T('venue')}, '^[\\d\\s\\-–—,():.]+$') or regexp_matches({_T('venue')}, '^\\d+\\s*\\(\\d*\\)'))"),
    ("venue_keeps_year", "error", f"regexp_matches({_T('venue')}, '{_YT}')"), ("venue_is_hostname", "warn", f"regexp_matches({_T('venue')}, '(?i)^[\\w.-]+\\.(com|org|edu|net|gov|io|cn|uk|de)$')"),
    ("venue_truncated", "warn", f"regexp_matches({_T('venue')}, '^(…|[.][.][.])') or regexp_matches({_T('venue')}, '(…|[.][.][.])$')"), ("venue_missing", "warn", f"{_T('venue')} = ''"),
    ("authors_missing", "warn", f"{_T('authors')} = ''"), ("authors_truncated", "warn", f"regexp_matches({_T('authors')}, '(…|[.][.][.])$')"),
    ("citations_without_link", "error", "coalesce(cited_by_count <> 0, false) and coalesce(cited_by_url, '') = ''"), ("negative_count", "error", "coalesce(cited_by_count < 0, false) or coalesce(versions_count < 0, false)"),
    ("cluster_id_missing", "warn", "coalesce(cluster_id, '') = '' and not coalesce(citation_only, false) and coalesce(extra.citation_id, '') = ''"),
]
_AUDIT_SQL = "with a as (" + " union all ".join(f"select '{n}' as \"check\", '{s}' as severity, count_if({p}) as count, count(*) as total from scholar_results" for n, s, p in _AUDIT) + ") "


@query(_AUDIT_SQL + 'select "check", severity, count, total, count / total as share from a where count > 0')
def audit_counts(spark, sf):
    return audit.audit_counts(results(spark, sf), audit.checks(YEAR))


@query(_AUDIT_SQL + "select \"check\", severity, count, total, count / total as share from a where severity = 'error' and count >= 3 and count / total >= 0.005")
def audit_alarms(spark, sf):
    return audit.audit_alarms(audit.audit_counts(results(spark, sf), audit.checks(YEAR)), 0.005)


@query(
    "with a as (" + " union all ".join(f"select '{n}' as \"check\", obs_id from scholar_results where {p}" for n, _, p in _AUDIT)
    + "), r as (select *, row_number() over (partition by \"check\" order by obs_id) as place from a) select \"check\", place, coalesce(nullif(case when length(title) <= 52 then title else regexp_replace(substr(title, 1, 51), '[\\s\\x{A0}]+$', '') || '…' end, ''), '<empty>') as title from r join scholar_results using (obs_id) where place <= 2"
)
def audit_examples(spark, sf):
    return audit.audit_examples(results(spark, sf), audit.checks(YEAR), "obs_id", 2).select("check", "place", "title")


# ---- delta

_DELTA = f"""
b as (select {KEY_SQL} as key, arg_max(struct_pack(t := coalesce(nullif(title, ''), {KEY_SQL}), n := cited_by_count), obs_id) as r from scholar_results where {AT_SQL} < 1735689600 group by all),
a as (select {KEY_SQL} as key, arg_max(struct_pack(t := coalesce(nullif(title, ''), {KEY_SQL}), n := cited_by_count), obs_id) as r from scholar_results where {AT_SQL} >= 1735689600 group by all),
d as (select coalesce(a.key, b.key) as key, coalesce(a.r.t, b.r.t) as label, case when b.key is null then 'added' when a.key is null then 'gone'
  when a.r.n is not null and a.r.n is distinct from b.r.n then 'moved' else 'same' end as status, b.r.n as bn, a.r.n as an from b full outer join a on a.key = b.key),
z as (select key, label, status, case when status = 'moved' then coalesce(bn, 0) end as before, case when status = 'moved' then an end as after, case when status = 'moved' then an - coalesce(bn, 0) end as change from d)
"""


def _delta(spark, sf) -> DataFrame:
    from .functions.times import iso_seconds

    r = keyed(results(spark, sf)).withColumn("at", iso_seconds(c("fetched_at")))
    label = F.coalesce(tx.filled(c("title")), c("work_key"))
    side = lambda df: delta.last_rows(df, c("work_key"), label, c("cited_by_count"), "obs_id")
    return delta.compare(side(r.where(c("at") < 1_735_689_600)), side(r.where(c("at") >= 1_735_689_600)))


@query(f"with {_DELTA} select * from z")
def delta_rows(spark, sf):
    return _delta(spark, sf)


@query(f"with {_DELTA} select count_if(status = 'added') as added, count_if(status = 'gone') as gone, count_if(status = 'moved') as moved, count_if(status = 'same') as same, coalesce(cast(sum(change) as bigint), 0) as citations_gained, count_if(status <> 'same') = 0 as quiet from z")
def delta_summary(spark, sf):
    return delta.delta_summary(_delta(spark, sf))


@query(f"with {_DELTA} select label from z where status = 'added' intersect select label from z where status = 'gone'")
def delta_reclustered(spark, sf):
    return delta.reclustered(_delta(spark, sf))


@query(f"with {_DELTA} select key, label, status, before, after, change from z where status = 'moved'")
def delta_movers(spark, sf):
    return delta.movers(_delta(spark, sf))


# ---- staleness

_PID = lambda f: f"(case when regexp_matches(trim({f}), '^\\d+$') then trim({f}) else nullif(regexp_extract({f}, '(?:cites|cluster)=(\\d+)', 1), '') end)"
_AGE = f"((epoch(timestamp '{NOW.replace('T', ' ')}') - {AT_SQL}) / 86400.0)"
_STALE = f"s as (select obs_id, {_AGE} as age_days, {_AGE} * log10(1 + greatest(coalesce(cited_by_count, 0), 0)) as pressure, coalesce({_PID('versions_url')}, {_PID('cited_by_url')}) as target from scholar_results)"


@query(f"with {_STALE} select obs_id, round(age_days, 6) as age_days, round(pressure, 6) as pressure, target from s where age_days >= 300")
def stale_rank(spark, sf):
    r = stale.rank_stale(results(spark, sf), F.lit(NOW).cast("timestamp"), 300)
    return r.select("obs_id", F.round("age_days", 6).alias("age_days"), F.round("pressure", 6).alias("pressure"), "target")


@query(f"with {_STALE}, r as (select *, row_number() over (order by pressure desc, age_days desc, obs_id) as n from s where age_days >= 300), t as (select target, min(n) as n from r where target is not null group by all order by n limit 20) select target, obs_id from t join r using (target, n)")
def refresh_targets(spark, sf):
    return stale.refresh_targets(stale.rank_stale(results(spark, sf), F.lit(NOW).cast("timestamp"), 300)).select("target", "obs_id")


@query(f"with {_STALE} select count(*) as records, count_if(age_days is null) as undated, round(min(age_days), 6) as youngest, round(max(age_days), 6) as oldest, count_if(age_days >= 300) as stale, count_if(age_days >= 300 and target is not null) as refreshable, max(age_days) - min(age_days) < 1 as same_age from s")
def stale_stats(spark, sf):
    return stale.stale_stats(results(spark, sf), F.lit(NOW).cast("timestamp"), 300).withColumns({k: F.round(k, 6) for k in ("youngest", "oldest")})


# ---- graph

_EDGES = f"""
o as (select {KEY_SQL} as citing, case when starts_with(query, 'cites:') then nullif(substr(query, 7), '') end as target, obs_id from scholar_results),
kept as (select *, {KEY_SQL} as k from scholar_results where coalesce(cited_by_count, 0) >= 3),
own as (select {_PID('cited_by_url')} as target, arg_max(k, obs_id) as cited from kept where {_PID('cited_by_url')} is not null group by all),
e as (select citing, coalesce(cited, 'cites:' || o.target) as cited, cited is null as stub, min(obs_id) as first from o left join own using (target)
  where o.target is not null and citing in (select k from kept) group by all),
edges as (select * from e where citing <> cited)
"""


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    r = results(spark, sf)
    kept = filters.filter_records(r, 3)
    return graph.nodes_of(kept, "obs_id"), graph.build_edges(r, kept, "obs_id")


@query(f"with {_EDGES} select citing, cited, stub, first from edges")
def graph_edges(spark, sf):
    return _graph(spark, sf)[1]


@query(f"with {_EDGES}, n as (select k as key, min(obs_id) as first from kept group by all) select key, first, false as stub from n union all select cited, min(first), true from edges where stub group by all")
def graph_nodes(spark, sf):
    n, e = _graph(spark, sf)
    return graph.all_nodes(n, e).select("key", "first", "stub")


@query(f"with {_EDGES} select cited as key, count(*) as in_degree, min(first) as first from edges group by all")
def graph_in_degree(spark, sf):
    return graph.in_degree(_graph(spark, sf)[1])


@query(f"with {_EDGES} select citing as key, count(*) as out_degree from edges group by all")
def graph_out_degree(spark, sf):
    return graph.out_degree(_graph(spark, sf)[1])


@query(f"with {_EDGES} select cited as key, count(*) as in_degree, min(first) as first from edges group by all order by in_degree desc, first limit 5")
def graph_hubs(spark, sf):
    return graph.hubs(_graph(spark, sf)[1])


@query(f"with {_EDGES} select distinct k as key from kept where k not in (select citing from edges) and k not in (select cited from edges)")
def graph_isolated(spark, sf):
    n, e = _graph(spark, sf)
    return graph.isolated(n, e).select("key")


_COMPONENTS = f"""
with recursive {_EDGES}, both_ways as (select citing as a, cited as b from edges union select cited, citing from edges),
walk(a, b) as (select a, b from both_ways union select w.a, s.b from walk w join both_ways s on w.b = s.a),
least as (select a as key, least(a, min(b)) as component from walk group by a),
n as (select k as key from kept union select cited from edges where stub)
"""


@query(_COMPONENTS + "select n.key, coalesce(component, n.key) as component from n left join least using (key)")
def graph_components(spark, sf):
    n, e = _graph(spark, sf)
    return graph.components(graph.all_nodes(n, e), e)


@query(
    _COMPONENTS + """, c as (select n.key, coalesce(component, n.key) as component from n left join least using (key)), z as (select component, count(*) as size from c group by all)
select (select count(distinct k) from kept) as collected, (select count(distinct cited) from edges where stub) as uncollected, (select count(*) from edges) as edges, count(*) as components, max(size) as largest,
  (select count(distinct k) from kept where k not in (select citing from edges) and k not in (select cited from edges)) as isolated from z"""
)
def graph_summary(spark, sf):
    n, e = _graph(spark, sf)
    return graph.network_summary(n, e)


@query(
    _COMPONENTS + """, f as (select key, min(first) as first from (select k as key, obs_id as first from kept union all select cited, first from edges where stub) group by all),
c as (select f.key, f.first, coalesce(component, f.key) as component from f left join least using (key))
select component, count(*) as size, arg_min(key, struct_pack(f := first, k := key)) as first_key from c group by all"""
)
def component_sizes(spark, sf):
    n, e = _graph(spark, sf)
    return graph.component_sizes(graph.all_nodes(n, e), e)


@query(
    f"""with p as (select {_PID('cited_by_url')} as t, coalesce(cited_by_count, 0) as n, obs_id, query from scholar_results where {_PID('cited_by_url')} is not null),
l1 as (select t, max(n) as n, arg_min(obs_id, struct_pack(n := -n, o := obs_id)) as o from p where n >= 1 group by t order by 2 desc, 3 limit 5),
l2 as (select t, max(n) as n, arg_min(obs_id, struct_pack(n := -n, o := obs_id)) as o from p where n >= 1 and query in (select 'cites:' || t from l1) and t not in (select t from l1) group by t order by 2 desc, 3 limit 5)
select t as cites_id, n as citations, 1 as level from l1 union all select t, n, 2 from l2"""
)
def expand_levels(spark, sf):
    r = results(spark, sf)
    return graph.follow(r, r, 2, 5, 1)


# ---- scalar functions over records


@query(f"select obs_id, {_PID('cited_by_url')} as cites_id, {_PID('versions_url')} as cluster, case when starts_with(query, 'cites:') then nullif(substr(query, 7), '') end as target from scholar_results")
def parse_ids(spark, sf):
    return results(spark, sf).select("obs_id", ids.parse_id(c("cited_by_url")).alias("cites_id"), ids.parse_id(c("versions_url")).alias("cluster"), ids.cited_target(c("query")).alias("target"))


@query("select user_id, case when regexp_matches(user_id, '^[\\w-]{12}$') then user_id end as bare, nullif(regexp_extract('https://x.example/c?user=' || user_id || '&hl=en', 'user=([\\w-]{12})', 1), '') as found from author_profiles")
def parse_users(spark, sf):
    p = read(spark, sf, "author_profiles")
    return p.select("user_id", F.when(ids.parse_user(c("user_id")) == c("user_id"), c("user_id")).alias("bare"), ids.parse_user(F.concat(F.lit("https://x.example/c?user="), c("user_id"), F.lit("&hl=en"))).alias("found"))


@query(
    f"with {_VENUE} select obs_id, name, nullif(regexp_extract(cleaned, '{_TAIL}', 1), '') as volume, nullif({_STRIP(f'''regexp_extract(cleaned, '{_TAIL}', 2)''')}, '') as number, "
    f"nullif(replace(regexp_extract(cleaned, '{_TAIL}', 3), ' ', ''), '') as pages, cut_head, cut_tail, label from v where venue is not null"
)
def split_venues(spark, sf):
    v = vx.split_venue(c("venue"))
    return results(spark, sf).where("venue is not null").select("obs_id", *[v[n].alias(n) for n in ("name", "volume", "number", "pages", "cut_head", "cut_tail")], vx.normalize_venue(c("venue")).alias("label"))


_FIELD = f"(case when {{0}} = '' or {{0}} <> name or not (cut_head or cut_tail) then {{0}} else {{0}} || ' ...' end)".format(_STRIP("regexp_replace(name, '(?i)\\s+arxiv$', '')"))


@query(f"with {_VENUE}, f as (select obs_id, {_FIELD} as venue_field from v where venue is not null) select *, case when venue_field = '' then 'misc' when regexp_matches(venue_field, '(?i)\\b(proceedings|conference|workshop|symposium|congress|meeting)\\b') then 'inproceedings' else 'article' end as kind from f")
def venue_fields(spark, sf):
    return results(spark, sf).where("venue is not null").select("obs_id", vx.venue_field(c("venue")).alias("venue_field"), vx.entry_type(c("venue")).alias("kind"))


@query(f"select obs_id, {_FIRST} as first_author from scholar_results")
def first_authors(spark, sf):
    return results(spark, sf).select("obs_id", tx.first_author(c("authors"), c("byline")).alias("first_author"))


@query("select obs_id, list_transform(regexp_extract_all(venue, '\\d[\\d,.\\s\\x{A0}]*'), lambda x: cast(regexp_replace(x, '[^0-9]', '', 'g') as bigint)) as ints, try_cast(regexp_replace(regexp_extract(venue, '\\d[\\d,.\\s\\x{A0}]*'), '[^0-9]', '', 'g') as bigint) as first from scholar_results where venue is not null")
def ints_in_labels(spark, sf):
    return results(spark, sf).where("venue is not null").select("obs_id", tx.all_ints(c("venue")).alias("ints"), tx.first_int(c("venue")).alias("first"))


@query("select obs_id, case when length(snippet) <= 60 then snippet else regexp_replace(substr(snippet, 1, 59), '[\\s\\x{A0}]+$', '') || '…' end as short, regexp_replace(title, '^\\s*\\[[^\\]]{1,12}\\]\\s*', '') as bare from scholar_results")
def clips(spark, sf):
    return results(spark, sf).select("obs_id", tx.clip(c("snippet"), 60).alias("short"), tx.strip_tag(c("title")).alias("bare"))


@query()
def split_bylines(spark, sf):
    b = tx.split_byline(c("byline"))
    return results(spark, sf).select("obs_id", b["authors"].alias("authors"), b["venue"].alias("venue"), b["year"].alias("year"))


@query("select p_partkey, lower(p_name) as fold, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as slug from part")
def slugs(spark, sf):
    return read(spark, sf, "part").select("p_partkey", tx.casefold(c("p_name")).alias("fold"), tx.ascii_slug(c("p_name")).alias("slug"))


@query("select event_type, count(*) as n, case when count(*) = 1 then '1 event' else format('{:,}', count(*)) || ' events' end as label from events group by all")
def counted_labels(spark, sf):
    e = read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("label", tx.counted(c("n"), "event"))


_Q = lambda e: f"replace(url_encode({e}), '%20', '+')"


@query(
    f"select distinct query, '{HOST}/scholar?hl=en&q=' || {_Q('query')} || '&start=10&as_ylo=2020&as_rr=1&as_vis=1&as_sdt=0%2C5' as search, '{HOST}/citations?user=' || {_Q('query')} || '&hl=de&cstart=100&pagesize=100&sortby=pubdate' as profile, "
    f"'{HOST}/scholar?q=' || {_Q(f'''('info:' || query || ':{SITE}/')''')} || '&output=cite&scirp=0&hl=en' as cite from scholar_results where query <> ''"
)
def request_urls(spark, sf):
    q, h, none, no, yes = c("query"), F.lit(HOST), F.lit(None), F.lit(False), F.lit(True)
    r = results(spark, sf).where("query <> ''").select("query").distinct()
    search = urls.search_url(h, q, none, none, F.lit(10), F.lit(2020), none, none, no, no, yes, yes)
    return r.select("query", search.alias("search"), urls.author_url(h, q, F.lit("de"), F.lit(100), yes).alias("profile"), urls.cite_url(h, q, SITE).alias("cite"))


@query(f"select obs_id, case when coalesce(cited_by_url, '') = '' then null when regexp_matches(cited_by_url, '^https?://') then cited_by_url when starts_with(cited_by_url, '//') then 'https:' || cited_by_url when starts_with(cited_by_url, '/') then '{HOST}' || cited_by_url else '{HOST}/' || cited_by_url end as url from scholar_results")
def absolute_urls(spark, sf):
    return results(spark, sf).select("obs_id", urls.absolute(c("cited_by_url"), F.lit(HOST)).alias("url"))


@query(
    "with s as (select log_id, url, split_part(url, '#', 1) as u from challenge_log), p as (select *, regexp_extract(u, '^[^?]*\\?(.*)$', 1) as q, split_part(u, '?', 1) as h from s) "
    "select log_id, case when url is null then null when q = '' then url else h || '?' || array_to_string(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1) || '=' || "
    "case when (contains(h, '/sorry') and split_part(x, '=', 1) = 'hl') or (not contains(h, '/sorry') and split_part(x, '=', 1) in ('q','start','cites','cluster','user','hl','as_sdt','as_ylo','as_yhi','cstart','pagesize')) "
    "then replace(url_encode(url_decode(replace(regexp_replace(x, '^[^=]*=?', ''), '+', ' '))), '%20', '+') else 'REDACTED' end), '&') end as url from p"
)
def redacted_urls(spark, sf):
    return read(spark, sf, "challenge_log").select("log_id", urls.redact_url(c("url")).alias("url"))


_SIG = r"^(.*)\|cites=([^|]*)\|cluster=([^|]*)\|lo=([^|]*)\|hi=([^|]*)\|lang=([^|]*)\|date=([^|]*)\|cit=([^|]*)\|pat=([^|]*)\|rev=([^|]*)$"
_S = lambda k: f"nullif(regexp_extract(signature, '{_SIG}', {k}), '')"
_A = lambda k: f"nullif(regexp_extract(signature, '^author=([^|]*)\\|lang=([^|]*)\\|year=([^|]*)$', {k}), '')"


@query(
    f"select signature, case when starts_with(signature, 'author=') then 'author' else 'search' end as kind, {_A(1)} as user_id, case when not starts_with(signature, 'author=') then coalesce({_S(1)}, '') end as query, {_S(2)} as cites, {_S(3)} as cluster, "
    f"try_cast({_S(4)} as bigint) as year_low, try_cast({_S(5)} as bigint) as year_high, coalesce({_A(2)}, {_S(6)}) as language from resume_state where regexp_matches(signature, '{_SIG}') or starts_with(signature, 'author=')"
)
def parse_signatures(spark, sf):
    r = ids.parse_signature(c("signature"))
    return read(spark, sf, "resume_state").withColumn("r", r).where("r is not null").select("signature", *[c("r")[n].alias(n) for n in ("kind", "user_id", "query", "cites", "cluster", "year_low", "year_high", "language")])


@query("select signature, signature as again from resume_state")
def signature_roundtrip(spark, sf):
    s = read(spark, sf, "resume_state").withColumn("r", ids.parse_signature(c("signature")))
    r = c("r")
    search = ids.search_signature(r["query"], r["cites"], r["cluster"], r["year_low"], r["year_high"], r["language"], r["sorted"], r["citations"], r["patents"], r["reviews"])
    return s.select("signature", F.when(r.isNull(), c("signature")).when(r["kind"] == "author", ids.author_signature(r["user_id"], r["language"], r["sorted"])).otherwise(search).alias("again"))


_LO, _HI = (f"nullif(try_cast({_S(k)} as bigint), 0)" for k in (4, 5))


@query(
    f"with d as (select signature, case when {_A(1)} is not null then 'author:' || {_A(1)} else coalesce({_S(1)}, 'cites:' || {_S(2)}, 'cluster:' || {_S(3)}) end as label, "
    f"case when {_A(1)} is not null then [coalesce({_A(2)}, ''), case when {_A(3)} = '1' then 'by year' else '' end] else [coalesce({_S(6)}, ''), "
    f"trim(coalesce(cast({_LO} as varchar), '') || '-' || coalesce(cast({_HI} as varchar), ''), '-'), case when {_S(7)} = '1' then 'by date' else '' end, case when {_S(8)} is distinct from '1' then 'no citations' else '' end, "
    f"case when {_S(9)} is distinct from '1' then 'no patents' else '' end, case when regexp_extract(signature, '\\|rev=([^|]*)$', 1) = '1' then 'reviews only' else '' end] end as said, regexp_matches(signature, '{_SIG}') or starts_with(signature, 'author=') as known from resume_state) "
    "select signature, case when not known then signature else label || (case when len(list_filter(said, lambda x: x <> '')) > 0 then ' [' || array_to_string(list_filter(said, lambda x: x <> ''), ', ') || ']' else '' end) end as described from d"
)
def describe_signatures(spark, sf):
    return read(spark, sf, "resume_state").select("signature", ids.describe_signature(c("signature")).alias("described"))


# ---- bibliography


@query("select count_if(regexp_matches(title, '\\S')) as written, count_if(regexp_matches(title, '\\S') and extra.bibtex_key <> '') as reused_keys, count_if(regexp_matches(title, '\\S') and (ends_with(trim(coalesce(nullif(authors, ''), split_part(coalesce(byline, ''), ' - ', 1))), '…') or ends_with(trim(coalesce(nullif(authors, ''), split_part(coalesce(byline, ''), ' - ', 1))), '...'))) as truncated_authors, count_if(title is null or not regexp_matches(title, '\\S')) as skipped from scholar_results")
def bibliography_report(spark, sf):
    return biblio.bibliography_report(results(spark, sf))


@query()
def bibliography_entries(spark, sf):
    return biblio.bibliography(results(spark, sf), "obs_id", SITE)


@query("select count(*) as entries, count(*) as keys, 0 as not_of_base, count(*) as parsed from scholar_results where regexp_matches(title, '\\S')")
def citation_keys(spark, sf):
    """What must hold of a bibliography: every key once, each a base with at most one letter, each entry read back to its key."""
    b = biblio.bibliography(results(spark, sf), "obs_id", SITE)
    r = results(spark, sf).select("obs_id", bx.base_key(c("authors"), c("byline"), c("year"), c("title"), c("extra.bibtex_key")).alias("base"))
    both = b.join(r, "obs_id").withColumn("right", c("key").startswith(c("base")) & (F.length("key") - F.length("base") <= 1))
    return both.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("key").alias("keys"), F.count_if(~c("right")).alias("not_of_base"), F.count_if(bx.bibtex_key(c("entry")) == F.regexp_extract("key", r"^([^,\s]+)", 1)).alias("parsed"))


@query("select o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z]', '', 'g') || cast(year(o_orderdate) as varchar) as base, row_number() over (partition by regexp_replace(lower(o_orderpriority), '[^a-z]', '', 'g') || cast(year(o_orderdate) as varchar) order by o_orderkey) - 1 as n from orders")
def key_suffix(spark, sf):
    """Ranks within a base, read back from the suffix the keys got."""
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]", ""), F.year("o_orderdate").cast("string")).alias("base"))
    k = biblio.unique_keys(o, "base", "o_orderkey")
    tail = F.expr("substring(key, length(base) + 1)")
    return k.select("o_orderkey", "base", bx.suffix_number(tail).alias("n"))


# ---- event log, cursors, planning


def _event_lines(spark, sf) -> DataFrame:
    e = read(spark, sf, "challenge_log")
    fields = [f.name for f in schema.EVENT.fields]
    return e.select(c("log_id").alias("ord"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


_EVENTS = """e as (select log_id, coalesce("at", '') as at_, coalesce(nullif(kind, ''), '?') as kind, coalesce(nullif(request_index, 0), 0) as request_index, coalesce(nullif(consecutive, 0), 1) as consecutive, coalesce(waited, 0) as waited,
  coalesce(nullif(outcome, ''), '?') as outcome, coalesce(target, '') as target, coalesce(saw, []) as saw from challenge_log),
real as (select * from e where outcome <> 'rehearsed' and target <> 'rehearsal')"""


@query(f"with {_EVENTS} select log_id as ord, at_ as at, kind, request_index, consecutive, waited, outcome, target, len(saw) as n_saw from e".replace("at_ as at,", 'at_ as "at",'))
def event_scan(spark, sf):
    e = stores.parse_events(_event_lines(spark, sf))
    return e.select("ord", "at", "kind", "request_index", "consecutive", "waited", "outcome", "target", F.size("saw").cast("long").alias("n_saw"))


@query(f"with {_EVENTS} select count(*) as blocks, count_if(consecutive > 1) as back_to_back, cast(trunc(median(request_index)) as bigint) as typical_request, arg_max(at_, log_id) as last_at from real")
def block_history(spark, sf):
    return planning.block_history(stores.parse_events(_event_lines(spark, sf)), "ord")


@query(f"with {_EVENTS} select kind, count(*) as n from real group by all")
def block_kinds(spark, sf):
    return planning.kinds(stores.parse_events(_event_lines(spark, sf)))


@query(f"with {_EVENTS} select log_id as ord, kind, outcome from e order by log_id desc limit 5")
def latest_events(spark, sf):
    return planning.latest(stores.parse_events(_event_lines(spark, sf)), "ord").select("ord", "kind", "outcome")


@query(
    f"with {_EVENTS}, h as (select count(*) as blocks, count_if(consecutive > 1) as b, cast(trunc(median(request_index)) as bigint) as t from real), f as (select *, case when blocks < 2 then 1.0 else (case when blocks < 5 then 1.3 else 1.6 end) + (case when b > 0 then 0.2 else 0 end) + (case when t <= 30 then 0.2 else 0 end) end as x from h) "
    "select blocks, cast(x as double) as factor, cast(round_even(4.0 * x, 1) as double) as min_delay, cast(round_even(11.0 * x, 1) as double) as max_delay from f where blocks > 0"
)
def rate_advice(spark, sf):
    return planning.advise(planning.block_history(stores.parse_events(_event_lines(spark, sf)), "ord")).select("blocks", "factor", "min_delay", "max_delay")


@query("select log_id, case when contains(url, '/sorry/') or contains(url, 'sorry/index') then 'captcha' when regexp_matches(url, '^https://consent\\.') then 'consent' when regexp_matches(url, '^https?://accounts\\.') then 'sign_in' when contains(lower(reason), 'unusual traffic') then 'rate_limit' when contains(lower(reason), 'automated queries') then 'rate_limit' when contains(lower(reason), 'i''m not a robot') then 'captcha' when contains(lower(reason), 'type the characters') then 'captcha' when contains(lower(reason), 'before you continue') then 'consent' end as kind, case when contains(reason, 'Timeout') then 'timeout' else 'unknown' end as error from challenge_log")
def challenge_kinds(spark, sf):
    return read(spark, sf, "challenge_log").select("log_id", filters.classify_challenge(c("url"), c("reason")).alias("kind"), filters.classify_error(c("reason")).alias("error"))


def _state_file(spark, sf) -> DataFrame:
    """The cursors as state files: one JSON object for each hash of the signature (a store is many small files)."""
    s = read(spark, sf, "resume_state").withColumn("g", F.pmod(F.xxhash64("signature"), F.lit(64)))
    entry = F.to_json(F.struct("next_start", "exhausted", "updated_at"), {"ignoreNullFields": "false"})
    pair = F.concat(F.regexp_extract(F.to_json(F.struct(c("signature").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit(": "), entry)
    return s.groupBy("g").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ", "), F.lit("}")).alias("value")).select("value")


@query("select signature, coalesce(next_start, 0) as next_start, coalesce(exhausted, false) as exhausted, coalesce(updated_at, '') as updated_at from resume_state")
def cursor_scan(spark, sf):
    return stores.parse_cursors(_state_file(spark, sf)).where("not dropped").select("signature", "next_start", "exhausted", "updated_at")


@query("select signature, next_start, updated_at from resume_state where updated_at is not null")
def cursor_listing(spark, sf):
    """All cursors, the latest first."""
    return read(spark, sf, "resume_state").where("updated_at is not null").orderBy(F.desc("updated_at"), "signature").select("signature", "next_start", "updated_at")


@query("select signature, case when next_start > 10 and not coalesce(exhausted, false) then next_start + 10 else next_start end as next_start, case when next_start > 10 and not coalesce(exhausted, false) then true else exhausted end as exhausted from resume_state")
def cursor_upsert(spark, sf):
    """Cursors behind the first pages moved on by a page and ended."""
    s = read(spark, sf, "resume_state")
    moved = s.where("next_start > 10 and not coalesce(exhausted, false)").withColumns({"next_start": c("next_start") + 10, "exhausted": F.lit(True)})
    return sinks.upsert_cursors(s, moved).select("signature", "next_start", "exhausted")


@query("select signature from resume_state where contains(lower(signature), 'au')")
def cursor_forget(spark, sf):
    s = read(spark, sf, "resume_state")
    return sinks.split_forgotten(s, "AU", c("signature"))[1].select("signature")


@query("select r.signature, coalesce(s.next_start, 0) as next_start, coalesce(s.exhausted, false) as exhausted from (select signature from resume_state where exhausted) r left join (select * from resume_state where next_start > 10) s using (signature)")
def cursor_lookup(spark, sf):
    s = read(spark, sf, "resume_state")
    asked = s.where("exhausted").select("signature")
    return planning.cursors_of(asked, s.where("next_start > 10"))


_PLAN = """with n as (select count_if(not starts_with(signature, 'author=')) as l, count_if(starts_with(signature, 'author=')) as a from resume_state),
p as (select *, l * 3 + a * 1 as seed_loads, l * 25 + a * 25 as seed_records, (l + a) * (5 + 25) as follow_listings from n),
q as (select *, follow_listings * 3 as follow_loads, follow_listings * 25 as follow_records from p),
r as (select *, (l * 25 + follow_records) * 2 + a * 25 * 3 as bibtex_loads from q), t as (select *, seed_loads + follow_loads + bibtex_loads as total_loads, seed_records + follow_records as total_records from r)
select l as listings, a as authors, seed_loads, seed_records, follow_listings, follow_loads, follow_records, bibtex_loads, total_loads, total_records, total_loads // 10 as cooldowns,
  cast(greatest(total_loads - 1, 0) * 7.5 + total_loads * 3.0 + (total_loads // 10) * 90.0 as double) as seconds from t"""


@query(_PLAN)
def plan_cost(spark, sf):
    s = read(spark, sf, "resume_state").select(F.when(c("signature").startswith("author="), "author").otherwise("listing").alias("kind"))
    return planning.plan_cost(s, planning.Budget(pages=5, max_results=25, depth=2, breadth=5, bibtex=True))


@query("select 'lines' as what, 5 as n")
def plan_lines(spark, sf):
    """A plan in words has a line for its seeds, its expansion, its exports, in all and for its time."""
    b = planning.Budget(pages=5, max_results=25, depth=2, breadth=5, bibtex=True)
    return planning.plan_text(plan_cost(spark, sf), b).agg(F.lit("lines").alias("what"), F.count(F.lit(1)).alias("n"))


@query(
    f"with {_EVENTS}, l as (select count(*) as requests, coalesce(sum(consecutive), 0) as retries, cast(coalesce(max(request_index) - min(request_index), 0) as double) as elapsed from challenge_log) "
    "select requests, cast(retries as bigint) as retries, elapsed, case when elapsed >= 30 then requests / (elapsed / 60) end as per_minute, (select count(*) from real) as takeovers, (select count(distinct kind) from real) as n_kinds from l"
)
def run_statistics(spark, sf):
    loads = read(spark, sf, "challenge_log").select(c("request_index").alias("at"), c("consecutive").alias("retries"))
    stats = planning.run_statistics(loads, stores.parse_events(_event_lines(spark, sf)))
    return stats.select("requests", "retries", "elapsed", "per_minute", "takeovers", F.size("kinds").cast("long").alias("n_kinds"))


@query("select signature, regexp_matches(signature, '%s') or starts_with(signature, 'author=') as resumes from resume_state" % _SIG)
def resume_commands(spark, sf):
    text = planning.resume_text(c("signature"), "collect")
    return read(spark, sf, "resume_state").select("signature", (text.startswith("collect --") & text.endswith(" --resume")).alias("r")).select("signature", F.coalesce("r", F.lit(False)).alias("resumes"))


@query("select distinct query as value, 'given' as side from scholar_results where query <> '' and trim(query) <> '' and not starts_with(trim(query), '#')")
def target_union(spark, sf):
    """The queries as a list file, after a given one that is in it too."""
    at = _folder(spark)
    q = results(spark, sf).where("trim(query) <> ''").select("query").distinct()
    q.select(F.regexp_replace("query", "\n", " ").alias("value")).write.text(at)
    return jsonl.target_list(spark, [], at).select("value", F.lit("given").alias("side")).distinct()


# ---- sinks and streams


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/queries/{uuid.uuid4().hex}"


_SOME = [f.name for f in schema.RECORD.fields if f.name != "extra"]


@query(f"select {', '.join(_SOME)}, {', '.join(f'extra.{x} as {x}' for x in _PARTS)} from scholar_results")
def sink_roundtrip_jsonl(spark, sf):
    at = _folder(spark)
    sinks.write_jsonl(results(spark, sf), at)
    parsed = jsonl.parse_lines(spark.read.text(at).withColumn("ord", F.lit(0)))
    return parsed.select(*_SOME, *[c(f"extra.{x}").alias(x) for x in _PARTS])


@query("select " + ", ".join(f"case when {x} then 'True' when not {x} then 'False' else '' end as {x}" if x == "citation_only" else f"coalesce(cast({x} as varchar), '') as {x}" for x in schema.CSV_COLUMNS) + " from scholar_results")
def sink_roundtrip_csv(spark, sf):
    at = _folder(spark)
    sinks.write_csv(results(spark, sf), at)
    back = spark.read.csv(at, header=True, escape='"', quote='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="\u0001", emptyValue="")
    return back.select(*[F.coalesce(x, F.lit("")).alias(x) for x in schema.CSV_COLUMNS])


_APPEND = f"with k as (select {KEY_SQL} as work_key, obs_id, year from scholar_results), m as (select work_key from k where year < 2015), f as (select work_key, min(obs_id) as obs_id from k where (year >= 2015 or year is null) and work_key not in (select work_key from m) group by all) select work_key, obs_id from f"


@query(_APPEND)
def append_dedup(spark, sf):
    r = keyed(results(spark, sf)).select("work_key", "obs_id", "year")
    return merge.new_rows(r.where("year >= 2015 or year is null"), "work_key", "obs_id", r.where("year < 2015")).select("work_key", "obs_id")


@query("select user_id, coalesce(max(case when name is not null then coalesce(cited_by_total, -1) end), max(coalesce(cited_by_total, -1))) as n from author_profiles group by all")
def upsert_profiles(spark, sf):
    """Profiles without a name stored first, those with one written over them; the greatest total is the last row."""
    p = read(spark, sf, "author_profiles").select("user_id", "name", F.coalesce("cited_by_total", F.lit(-1)).alias("n"))
    return sinks.upsert(p.where("name is null"), p.where("name is not null"), "user_id", "n").select("user_id", "n")


def _stream(spark, sf) -> DataFrame:
    at = f"{sf}/scholar_results.parquet"
    like = spark.read.parquet(at).schema
    source = spark.readStream.schema(like).format("parquet")
    if "://" not in at and os.path.isfile(at):
        return source.option("pathGlobFilter", "scholar_results.parquet").load(sf)
    return source.load(at)


@query(f"select {KEY_SQL} as work_key, count(*) as n from (select distinct {KEY_SQL} as k, * from scholar_results qualify row_number() over (partition by {KEY_SQL} order by obs_id) = 1) group by all")
def stream_append(spark, sf):
    at = _folder(spark)
    key = ids.work_key(c("cluster_id"), c("title"), c("link"))
    streaming.append_new(_stream(spark, sf), key, "obs_id", f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy(c("__key").alias("work_key")).agg(F.count(F.lit(1)).alias("n"))


@query(_AUDIT_SQL + 'select "check", severity, count, total, count / total as share from a where count > 0')
def stream_audit(spark, sf):
    name, checks = f"audit_{uuid.uuid4().hex}", audit.checks(YEAR)
    streaming.audit_stream(_stream(spark, sf), checks, name, f"{_folder(spark)}/state").awaitTermination()
    return streaming.audit_result(spark.table(name), checks)


@query("select cluster_id, max(obs_id) as obs_id from scholar_results where cluster_id is not null group by all")
def stream_upsert(spark, sf):
    at = _folder(spark)
    rows = _stream(spark, sf).where("cluster_id is not null").select("cluster_id", "obs_id")
    streaming.upsert_stream(rows, "cluster_id", "obs_id", f"{at}/out", f"{at}/state").awaitTermination()
    return streaming.stored_rows(spark, f"{at}/out", "cluster_id")


# ---- saved pages


def _pages(spark, sf) -> DataFrame:
    """A saved page for every record, with one card."""
    esc = lambda e: F.replace(F.replace(F.replace(F.coalesce(e, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    r = results(spark, sf)
    anchor = F.when(c("link").isNotNull(), F.concat(F.lit('<a href="'), esc(c("link")), F.lit('">'), esc(c("title")), F.lit("</a>"))).otherwise(esc(c("title")))
    cited = F.when(c("cited_by_count").isNotNull() & (c("cited_by_count") >= 0), F.concat(F.lit('<a href="/scholar?cites=77&amp;hl=en">Cited by '), c("cited_by_count").cast("string"), F.lit("</a>"))).otherwise("")
    versions = F.when(c("versions_count") >= 0, F.concat(F.lit('<a href="/scholar?cluster=88&amp;hl=en">All '), c("versions_count").cast("string"), F.lit(" versions</a>"))).otherwise("")
    head = F.concat(F.lit('<html><body><div class="gs_ab_mdw">About '), F.format_number("obs_id", 0), F.lit(' results</div><div class="gs_r gs_or gs_scl" data-cid="'), esc(c("cluster_id")), F.lit('"><h3 class="gs_rt">'))
    body = F.concat(head, anchor, F.lit('</h3><div class="gs_a">'), esc(c("byline")), F.lit('</div><div class="gs_rs">'), esc(c("snippet")), F.lit('</div><div class="gs_fl gs_flb">'), cited, versions, F.lit('</div></div><a href="/scholar?start=10&amp;q=x">Next</a></body></html>'))
    return r.select(c("obs_id").alias("page_id"), body.alias("html"))


_COLLAPSE = lambda e: _STRIP(f"regexp_replace(regexp_replace({e}, '[\\s\\x{{A0}}]+', ' ', 'g'), '\\s+([,;.])', '\\1', 'g')")


@query(
    f"select obs_id as page, regexp_replace({_COLLAPSE("coalesce(title, '')")}, '^\\s*\\[[^\\]]{{1,12}}\\]\\s*', '') as title, {_COLLAPSE("coalesce(byline, '')")} as byline, {_COLLAPSE("coalesce(snippet, '')")} as snippet, "
    f"nullif({_STRIP(f"split_part({_COLLAPSE("coalesce(byline, '')")}, ' - ', 1)")}, '') as authors, case when cited_by_count >= 0 then '{HOST}/scholar?cites=77&hl=en' end as cited_by_url, "
    f"case when versions_count >= 0 then '{HOST}/scholar?cluster=88&hl=en' end as versions_url, cast(null as varchar) as related_url, cast(null as varchar) as resource_link, cast(null as varchar) as resource_type, 0 as page_start, "
    f"coalesce(cluster_id, '') as cluster_id, 1 as position, case when coalesce(link, '') = '' then null when regexp_matches(link, '^https?://') then link else '{HOST}/' || link end as link, case when cited_by_count >= 0 then cited_by_count end as cited_by_count, "
    "case when versions_count >= 0 then versions_count end as versions_count, link is null as citation_only from scholar_results"
)
def html_cards(spark, sf):
    return html.result_cards(_pages(spark, sf), F.lit(HOST)).drop("venue", "year")


@query("select obs_id as page, obs_id as total_estimate, true as has_next from scholar_results")
def html_facts(spark, sf):
    return html.page_facts(_pages(spark, sf))


_STATS = ("cited_by_total", "cited_by_recent", "h_index", "h_index_recent", "i10_index", "i10_index_recent")
_FACTS = ("name", "affiliation", "organization", "verified_email")


def _profile_pages(spark, sf) -> DataFrame:
    """A saved page for every profile, with the greatest value of each field."""
    p = read(spark, sf, "author_profiles").groupBy("user_id").agg(*[F.max(x).alias(x) for x in (*_STATS, *_FACTS, "homepage")])
    esc = lambda e: F.replace(F.replace(F.replace(F.coalesce(e, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    td = lambda e: F.concat(F.lit('<td class="gsc_rsb_std">'), F.coalesce(e.cast("string"), F.lit("")), F.lit("</td>"))
    row = lambda a, b: F.concat(F.lit("<tr><td>x</td>"), td(c(a)), td(c(b)), F.lit("</tr>"))
    body = F.concat(
        F.lit('<div id="gsc_prf_in">'), esc(c("name")), F.lit('</div><div class="gsc_prf_il">'), esc(c("affiliation")), F.lit(' <a class="gsc_prf_ila">'), esc(c("organization")), F.lit('</a></div><div class="gsc_prf_il" id="gsc_prf_ivh">'), esc(c("verified_email")),
        F.lit(' - <a href="http://'), F.lit(SITE), F.lit('/x">own</a><a href="'), esc(c("homepage")), F.lit('">Homepage</a></div><div id="gsc_prf_int"><a>reef  optics</a><a>moss</a></div><table id="gsc_rsb_st"><tbody>'),
        row("cited_by_total", "cited_by_recent"), row("h_index", "h_index_recent"), row("i10_index", "i10_index_recent"),
        F.lit('</tbody></table><table><tr class="gsc_a_tr"><td><a class="gsc_a_at" href="/v?citation_for_view='), c("user_id"), F.lit(':1">On <b>x</b></a><div class="gs_gray">A B</div><div class="gs_gray">Reef Letters 3, 2019</div></td><td><a class="gsc_a_ac" href="/scholar?cites=5">7</a></td><td><span class="gsc_a_h">2019</span></td></tr></table><button id="gsc_bpf_more" disabled>'),
    )
    return p.select("user_id", body.alias("html"))


@query(
    "with p as (select user_id, " + ", ".join(f"max({x}) as {x}" for x in (*_STATS, *_FACTS, "homepage")) + " from author_profiles group by all) "
    f"select user_id, {_COLLAPSE("coalesce(name, '')")} as name, nullif({_COLLAPSE("coalesce(affiliation, '') || ' ' || coalesce(organization, '')")}, '') as affiliation, nullif({_COLLAPSE("coalesce(organization, '')")}, '') as organization, "
    "case when regexp_matches(homepage, '^https?://') then homepage end as homepage, nullif(trim(coalesce(verified_email, ''), ' -–'), '') as verified_email, ['reef optics', 'moss'] as interests, " + ", ".join(_STATS) + " from p"
)
def html_profiles(spark, sf):
    return html.profile_headers(_profile_pages(spark, sf), SITE)


@query(f"select distinct user_id, 'On x' as title, 'A B' as authors, 'Reef Letters 3' as venue, 2019 as year, 7 as cited_by_count, '{HOST}/scholar?cites=5' as cited_by_url, user_id || ':1' as citation_id, 'author:' || user_id as query from author_profiles")
def html_publications(spark, sf):
    return html.profile_rows(_profile_pages(spark, sf), F.lit(HOST)).select("user_id", "title", "authors", "venue", "year", "cited_by_count", "cited_by_url", "citation_id", "query")


@query(f"select obs_id, '/x?scisf=4&hl=en' as link, 'k' || cast(obs_id as varchar) as key from scholar_results")
def html_exports(spark, sf):
    popup = F.lit('<a href="/y">Text</a><a class="gs_citi" href="/x?scisf=4&amp;hl=en">Export</a>')
    page = F.concat(F.lit("<html><pre>@article{k"), c("obs_id").cast("string"), F.lit(",\n title={x}}</pre></html>"))
    return results(spark, sf).select("obs_id", html.bibtex_link(popup).alias("link"), bx.bibtex_key(bx.parse_bibtex(page)).alias("key"))


# ---- the digest as one plan


_DIGESTED = f"d as ({_merge_sql([f.name for f in schema.RECORD.fields if f.name != 'extra'], ('bibtex_key',))}), kept as (select * from d where coalesce(cited_by_count, 0) >= 0 and year >= 2010)"


@query(
    f"with {_DIGESTED}, {_VENUE.replace('from scholar_results', 'from kept')} select count(*) as records, cast(coalesce(sum(coalesce(cited_by_count, 0)), 0) as bigint) as citations, count_if(bibtex_key <> '') as with_bibtex, "
    f"count_if(coalesce(citation_only, false)) as citation_only, count_if(year is null or year = 0) as unknown_year, count(distinct lower({_VLABEL})) as venue_count, count(distinct lower({_FIRST})) as author_count from v"
)
def digest_overview(spark, sf):
    merged = digest.merge_records(results(spark, sf).withColumnRenamed("obs_id", "ord"))
    return summary.overview(filters.filter_records(merged, 0, 2010))


@query("select 'queries' as section, count(distinct query) as n from scholar_results where query <> ''")
def report_queries(spark, sf):
    """The report lists every query there is."""
    from datetime import datetime

    lines = build_report(results(spark, sf), datetime(2026, 9, 2), order="obs_id")
    return lines.where("n.section = 6 and n.part = 1 and n.k.a > -4611686018427387904").agg(F.lit("queries").alias("section"), F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, merge, filter, profile by venue: the path most users take."""
    merged = digest.merge_records(results(spark, sf).withColumnRenamed("obs_id", "ord"))
    return summary.group_profile(filters.filter_records(merged), summary.group_label("venue"), "ord")
