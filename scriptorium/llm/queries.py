"""Queries of the llm problems, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries import AT_SQL
from ..session import materialize
from .leaks import leaks, without_leaks
from .packing import CAPACITY, pack_documents, packing_report, token_sizes
from .resolution import entities, variant_pairs
from .spam import spam_pages
from .survivorship import DAMAGE, REPAIRABLE, SLACK, disputed_survivors, survivor_records
from .topn import top_n
from .truncation import cut_values, host, truncation_report
from .venues import map_venues, venue_candidates


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return variant_pairs(entities(read(spark, sf, "scholar_results"), read(spark, sf, "venue_list")))


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling with the smallest spelling of its entity, and how many there are."""
    e = entities(read(spark, sf, "scholar_results"), read(spark, sf, "venue_list"))
    of = e.groupBy("kind", "entity").agg(F.min("spelling").alias("entity_name"), F.count(F.lit(1)).alias("n_spellings"))
    return e.join(of, ["kind", "entity"]).select("kind", "spelling", "entity_name", "n_spellings")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return disputed_survivors(read(spark, sf, "scholar_results")).select("cluster_id", "field", "obs_id")


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    return survivor_records(read(spark, sf, "scholar_results"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "scholar_results").where("query <> '' and cited_by_count >= 0")
    return top_n(r, "query", "cluster_id", "cited_by_count", 5).select("query", "cluster_id", "place")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return map_venues(read(spark, sf, "scholar_results"), read(spark, sf, "venue_list")).select("obs_id", "venue_id")


def p6_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """How often each value that means no entry is typed."""
    m = map_venues(read(spark, sf, "scholar_results"), read(spark, sf, "venue_list"))
    return m.where("venue_id = 0").groupBy("venue").agg(F.count(F.lit(1)).alias("n_records"))


def p6_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All entries near each value that is typed."""
    return venue_candidates(read(spark, sf, "scholar_results"), read(spark, sf, "venue_list"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    v = cut_values(read(spark, sf, "scholar_results"), values=False)
    return v.where("way is not null").select("obs_id", "field")


def p7_ways(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each column were found cut by each way."""
    v = cut_values(read(spark, sf, "scholar_results"), values=False)
    return v.where("way is not null").groupBy("field", "way").agg(F.count(F.lit(1)).alias("n"))


def p7_sources(spark: SparkSession, sf: str) -> DataFrame:
    return truncation_report(read(spark, sf, "scholar_results"), source=host(F.col("link")))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(read(spark, sf, "documents"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing_report(pack_documents(read(spark, sf, "documents")))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of a packing: containers over their capacity, documents missing, without the right pieces, or in no
    container although they have tokens; tokens lost; container numbers left out."""
    packed = materialize(pack_documents(read(spark, sf, "documents")))
    sizes = token_sizes(read(spark, sf, "documents")).groupBy("doc_id").agg(F.sum("size").alias("tokens"))
    used = packed.where("container is not null").groupBy("container").agg(F.sum("size").alias("used"))
    full = used.agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), (F.coalesce(F.max("container") + 1, F.lit(0)) - F.count(F.lit(1))).alias("left_out"))
    per = packed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.count_if(F.expr("size > 0 and container is null")).alias("loose"), F.count_if(F.col("start") != F.col("piece") * CAPACITY).alias("shifted"))
    both = sizes.join(per, "doc_id", "full_outer")
    right = (F.col("n") == F.col("last") + 1) & (F.col("n") == F.greatest(F.ceil(F.col("tokens") / CAPACITY), F.lit(1))) & (F.col("shifted") == 0)
    docs = both.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n").isNull() | F.col("tokens").isNull()).alias("missing"), F.count_if(~right).alias("wrong_pieces"), F.coalesce(F.sum("loose"), F.lit(0)).alias("loose"),
        F.coalesce(F.sum("tokens") - F.sum("size"), F.lit(0)).alias("tokens_lost"),
    )
    both = docs.unionByName(full, allowMissingColumns=True)  # two rows
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which test items leaked, into how many documents, and how much of them at most."""
    found = leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("share").alias("most"))


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    return without_leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam_pages(read(spark, sf, "documents")).where("is_spam").select("doc_id")


def p10_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and spam pages of each host."""
    pages = spam_pages(read(spark, sf, "documents"))
    return pages.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("is_spam").alias("n_spam"), F.max("host_rate").alias("host_rate"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_entities, p3_found, p3_records, p5_found, p6_found, p6_unmatched, p6_candidates, p7_found, p7_ways, p7_sources,
        p8_pack, p8_report, p8_checks, p9_found, p9_items, p9_clean, p10_found, p10_hosts,
    )
}



def _survivor_sql() -> str:
    """The survivors field by field: the best usable row of a cluster, then the smallest row that holds its value."""
    damage, repairable = DAMAGE.replace("'", "''"), REPAIRABLE.replace("'", "''")
    mended = f"regexp_replace(regexp_replace(title, '{repairable}', '', 'g'), '&#?\\w{{1,8}};|â€.|Ã.|\\s+', '_', 'g')"
    shouting = "(title = upper(title) and title <> lower(title) and length(title) > 8)"
    rules = [("title", f"regexp_matches(title, '\\S') and not regexp_matches(title, '{damage}') and not {shouting}", "length(title)")]
    rules += [(f, f"regexp_matches(cast({f} as varchar), '\\S')", "case when coalesce(citation_only, false) then 0 else 1 end") for f in ("link", "year")]
    rules += [(f, f"{f} >= 0 and at_s is not null", "0") for f in ("cited_by_count", "versions_count")]
    one = lambda f, usable, prior: (
        f"select r.cluster_id, '{f}' as field, min(case when r.{f} = b.v then r.obs_id end) as obs_id from r join (select cluster_id, {f} as v from r where {usable} "
        f"qualify row_number() over (partition by cluster_id order by {prior} desc, at_s desc nulls last, {f} desc) = 1) b using (cluster_id) group by r.cluster_id "
        f"having count(distinct r.{f}) + max(case when r.{f} is null then 1 else 0 end) > 1" + (f" and coalesce(max(length({mended}) - {SLACK}), 0) <= length(any_value(b.v))" if f == "title" else "")
    )
    return f"with r as (select *, {AT_SQL} as at_s from scholar_results where cluster_id is not null) " + " union all ".join(one(*x) for x in rules)


ORACLES = {
    "p3_found": _survivor_sql(),
    "p8_checks": "select count(distinct doc_id) as documents, 0 as missing, 0 as wrong_pieces, 0 as loose, 0 as tokens_lost, 0 as overfull, 0 as left_out from documents",
    "p5_found": """
with s as (select query, cluster_id, max(cited_by_count) as c from scholar_results
  where query <> '' and cluster_id is not null and cited_by_count >= 0 group by all),
r as (select query, cluster_id, row_number() over (partition by query order by c desc, cluster_id) as place from s)
select query, cluster_id, place from r where place <= 5
""",
}
