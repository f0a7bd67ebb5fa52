"""A bibliography of records: unique citation keys, entries, counters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.biblio import authors_cut, base_key, bibtex_key, entry, key_suffix, letter_number
from ..functions.text import filled
from ..session import materialize
from ..sources.stores import first_per_key

SUFFIX_SLICE = 1_000_000


def unique_keys(df: DataFrame, base: str, order: str, key: str = "key") -> DataFrame:
    """``df`` with ``key``: the base, or the base with the first free letter, in order of rows.

    A rank within the base gives the letter.  Two bases meet only where one is the
    other with a letter behind it: both may want that key, and whose row comes
    first has it.  So for each base two things are worked out, from the roots of
    such chains on: whether its bare key is gone, and which letters it must pass over.
    That needs the place of a few rows of each (as many as the base has
    longer neighbours, twice), never the rows of a base together.
    A base of more rows than there are letters (1,111,967) gets further ones behind the last
    character, U+10FFFF, with which no base is taken to end.
    """
    rows = df.withColumn("__slice", F.floor(F.col(order) / SUFFIX_SLICE).cast("long"))
    per = rows.groupBy(base, "__slice").agg(F.count(F.lit(1)).alias("__c"))
    earlier = Window.partitionBy(base).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(base, "__slice", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(base, "__slice").orderBy(order)
    rows = rows.withColumn("__rn", F.row_number().over(within)).join(per, [base, "__slice"])
    rows = rows.withColumn("__n", (F.col("__rn") - 1 + F.col("__before")).cast("long")).drop("__slice", "__rn", "__before")
    rules = _meeting_rules(rows, base, order).withColumnRenamed("base", base)
    rows = rows.join(rules, base, "left")
    start = F.col("__n") + F.coalesce("__gone", F.lit(0))
    n = F.aggregate(F.coalesce("__passed", F.array().cast("array<long>")), start, lambda n, passed: F.when(n >= passed, n + 1).otherwise(n))
    rows = rows.withColumn("__letter", n).withColumn(key, F.concat(F.col(base), key_suffix(F.col("__letter"))))
    return rows.drop("__n", "__gone", "__passed", "__letter")


def _meeting_rules(rows: DataFrame, base: str, order: str) -> DataFrame:
    """``base``, ``__gone`` (1 if its bare key goes to a shorter base) and ``__passed`` (numbers of the letters that go to
    longer ones, ascending) of the bases that meet others; ``rows`` have their rank in ``__n``."""
    names = rows.groupBy(F.col(base).alias("base")).agg(F.min(order).alias("first"))
    letter = letter_number(F.right("base", F.lit(1)))
    longer = names.where((letter >= 1) & (F.length("base") > 1)).select("base", "first", letter.alias("letter"), F.expr("substring(base, 1, length(base) - 1)").alias("stem"))
    pairs = materialize(longer.join(names.select(F.col("base").alias("stem")), "stem"))  # read four times
    # The root of a chain: the shortest beginning of which every longer one is a base too.
    size = F.length("base")
    begun = pairs.select("base", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).withColumn("stem", F.expr("substring(base, 1, k)"))
    held = begun.join(names.select(F.col("base").alias("stem")), "stem").groupBy("base").agg(F.collect_set("k").alias("ks"))
    least = F.aggregate(F.sequence(size - 1, F.lit(1)), size, lambda at, k: F.when((at == k + 1) & F.array_contains("ks", k), k).otherwise(at))
    root = held.select("base", F.substring("base", F.lit(1), least).alias("root"))
    # The rows of a base that may want a letter: as many before that rank as there are letters to pass over, or one more.
    wants = pairs.groupBy("stem").agg(F.collect_set("letter").alias("letters"))
    ranks = F.array_distinct(F.flatten(F.transform("letters", lambda x: F.sequence(F.greatest(x - F.size("letters") - 1, F.lit(0)), x))))
    wanted = wants.select(F.col("stem").alias(base), F.explode(ranks).alias("__n"))
    places = rows.join(wanted, [base, "__n"]).groupBy(F.col(base).alias("base")).agg(F.map_from_entries(F.collect_list(F.struct("__n", order))).alias("places"))
    known = pairs.select("base", "first", "letter", "stem").join(root, "base")
    roots = known.select(F.col("root").alias("base"), "root").distinct().join(names, "base").select("base", "first", F.lit(0).cast("long").alias("letter"), F.lit("").alias("stem"), "root")
    chains = known.select("base", "first", "letter", "stem", "root").unionByName(roots).join(places, "base", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, gone = [], {}
        kids = {s: g.sort_values("letter") for s, g in pdf[pdf["stem"] != ""].groupby("stem")}
        for r in pdf.sort_values("base", key=lambda c: c.str.len()).itertuples():
            passed: list[int] = []
            bare = gone.get(r.base, 0)
            places = dict(r.places or {})
            for kid in kids[r.base].itertuples() if r.base in kids else ():
                rank = kid.letter - bare - len(passed)  # the row that wants this letter
                mine = places.get(rank) if rank >= 0 else None
                if mine is not None and mine < kid.first:
                    gone[kid.base] = 1
                else:
                    passed.append(int(kid.letter))
            out.append((r.base, bare, passed))
        return pd.DataFrame(out, columns=["base", "__gone", "__passed"])

    return chains.groupBy("root").applyInPandas(run, "base string, __gone long, __passed array<long>")


def bibliography(df: DataFrame, order: str, site: str) -> DataFrame:
    """``order``, ``key``, ``entry``, ``reused``, ``cut`` for every record with a title."""
    rows = df.where(F.col("title").rlike(r"\S"))
    c = F.col
    base = base_key(c("authors"), c("byline"), c("year"), c("title"), c("extra.bibtex_key"))
    bases = materialize(rows.select(order, base.alias("__base")))  # read four times
    keyed = rows.join(unique_keys(bases, "__base", order).select(order, "key"), order)
    text = entry(c("key"), c("title"), c("authors"), c("byline"), c("venue"), c("year"), c("link"), c("cited_by_count"), site)
    return keyed.select(order, "key", text.alias("entry"), filled(c("extra.bibtex_key")).isNotNull().alias("reused"), authors_cut(c("authors"), c("byline")).alias("cut"))


def bibliography_report(df: DataFrame) -> DataFrame:
    """``written``, ``reused_keys``, ``truncated_authors``, ``skipped`` without building the entries."""
    has = F.col("title").rlike(r"\S") & F.col("title").isNotNull()
    return df.agg(
        F.count_if(has).alias("written"), F.count_if(has & filled(F.col("extra.bibtex_key")).isNotNull()).alias("reused_keys"),
        F.count_if(has & authors_cut(F.col("authors"), F.col("byline"))).alias("truncated_authors"), F.count_if(~F.coalesce(has, F.lit(False))).alias("skipped"),
    )


def new_entries(entries: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """The rows of ``entries`` (``order``, ``entry``) that an append writes: the first of each citation key that no entry
    of ``stored`` has; an entry without a key is always written."""
    keyed = entries.withColumn("__key", bibtex_key(F.col("entry")))
    have = stored.select(bibtex_key(F.col("entry")).alias("__key")).where("__key is not null").distinct()
    fresh = first_per_key(keyed.where("__key is not null").join(have, "__key", "left_anti"), "__key", order)
    return fresh.unionByName(keyed.where("__key is null")).select(order, F.trim("entry").alias("entry"))


def with_entries(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Records beside the stored entry their ``extra.bibtex_key`` names; ``entries`` has ``entry``."""
    keyed = entries.select(bibtex_key(F.col("entry")).alias("__key"), "entry").where("__key is not null").groupBy("__key").agg(F.min("entry").alias("entry"))
    return records.join(keyed, records["extra.bibtex_key"] == keyed["__key"], "left").drop("__key")
