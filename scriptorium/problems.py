"""Queries of the general training-data problems (2 and 4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.times import iso_seconds
from .operators.history import counted, scd2_history, scd2_merge
from .operators.packed import author_names
from .session import materialize

ATTRS = ("cited_by_count", "versions_count")


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _attrs() -> dict:
    return {a: counted(a) for a in ATTRS}


def _dimension(spark: SparkSession, sf: str) -> DataFrame:
    return scd2_history(read(spark, sf, "scholar_results"), "cluster_id", iso_seconds(F.col("fetched_at")), _attrs())


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _dimension(spark, sf).select("cluster_id", "valid_from")


def p2_history(spark: SparkSession, sf: str) -> DataFrame:
    return _dimension(spark, sf).drop("attr_hash", "seen_until")


def p2_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension of three of every four records in order of arrival, merged with the others; some of those come late."""
    r = read(spark, sf, "scholar_results").select("obs_id", "cluster_id", iso_seconds(F.col("fetched_at")).alias("at"), *ATTRS)
    cut = r.agg(F.max("obs_id")).first()[0]
    old, new = r.where(F.col("obs_id") <= F.lit(cut) * 0.75), r.where(F.col("obs_id") > F.lit(cut) * 0.75)
    stored = materialize(scd2_history(old, "cluster_id", F.col("at"), _attrs()))
    return scd2_merge(stored, new, "cluster_id", F.col("at"), _attrs(), observations=old).drop("attr_hash", "seen_until")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return author_names(read(spark, sf, "scholar_results")).select("obs_id", "pos", "name")


#: Lists with one plain delimiter, which SQL can split too.
PLAIN = r"^[^;,|&/….()\"'\[\]]+(; [^;,|&/….()\"'\[\]]+)+$"


def p4_plain(spark: SparkSession, sf: str) -> DataFrame:
    """The names of all lists that have semicolons and nothing else between plain names."""
    names = author_names(read(spark, sf, "scholar_results"), keep=["obs_id", "authors"])
    return names.where(F.col("authors").rlike(PLAIN)).select("obs_id", "pos", "name")


QUERIES = {"p2_found": p2_found, "p2_history": p2_history, "p2_merge": p2_merge, "p4_found": p4_found, "p4_plain": p4_plain}

#: DuckDB: instants of one cluster with the attributes carried forward, and the versions they open.
_VERSIONS = r"""
with t as (
  select cluster_id,
    case when regexp_matches(fetched_at, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}')
      then cast(epoch(try_cast(substr(fetched_at, 1, 10) || ' ' || substr(fetched_at, 12, 8) as timestamp)) as bigint)
        - case when regexp_matches(fetched_at, '[+-]\d{2}:\d{2}$')
            then (case when substr(fetched_at, -6, 1) = '-' then -1 else 1 end)
              * (cast(substr(fetched_at, -5, 2) as bigint) * 3600 + cast(substr(fetched_at, -2, 2) as bigint) * 60)
            else 0 end
      end as ts_s,
    case when cited_by_count >= 0 then cited_by_count end as c,
    case when versions_count >= 0 then versions_count end as v
  from scholar_results where cluster_id is not null),
p as (select cluster_id, ts_s, max(c) as c, max(v) as v from t where ts_s is not null group by all),
k as (select cluster_id, ts_s, last_value(c ignore nulls) over w as c, last_value(v ignore nulls) over w as v
  from p window w as (partition by cluster_id order by ts_s rows unbounded preceding)),
o as (select *, lag(c) over w as pc, lag(v) over w as pv, row_number() over w as n from k window w as (partition by cluster_id order by ts_s)),
h as (select cluster_id, ts_s as valid_from, c as cited_by_count, v as versions_count from o
  where n = 1 or c is distinct from pc or v is distinct from pv)
"""
_HISTORY = _VERSIONS + """
select cluster_id, valid_from, lead(valid_from) over w as valid_to, cited_by_count, versions_count,
  lead(valid_from) over w is null as is_current
from h window w as (partition by cluster_id order by valid_from)
"""

ORACLES = {"p2_found": _VERSIONS + "select cluster_id, valid_from from h", "p2_history": _HISTORY, "p2_merge": _HISTORY}
ORACLES["p4_plain"] = f"""
with l as (select obs_id, string_split(authors, ';') as names from scholar_results where regexp_matches(authors, '{PLAIN.replace("'", "''")}'))
select obs_id, pos, trim(names[pos]) as name from l, unnest(range(1, len(names) + 1)) as t(pos)
"""
