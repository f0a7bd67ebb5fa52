"""Best representative of each duplicate group: survivorship field by field.

One aggregation takes, for each group and field, the maximum of a composite
struct (usable, source priority, time stamp, value); it combines before the
shuffle, so a group that holds a third of all rows sends one row per task.  The
same aggregation tells whether the rows of the group differ, and how much of the
value a damaged one shows.

Defined results: rows without group key are left out; a null or unusable value
never survives; equal candidates go to the greater value by bytes; repeated rows
change nothing; an empty input gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso_seconds

#: Marks of damage in a text: cut marks, tags in front, entities, broken encoding, doubled spaces.
DAMAGE = r"(?s)(…|\.\.\.)\s*$|^\s*(…|\.\.\.)|^\s*\[[^\]]{1,12}\]|&#?\w{1,8};|&#?\w{0,7}$|[\x{FFFD}]|Ã.|â€|<[^>]{0,20}>|<\w{0,3}$|\s{2,}|^\s|\s$|[\x{200B}\x{AD}]"

#: What is no part of a text although it stands in it: tags in front, cut marks, markup, outer white space.
REPAIRABLE = r"(?s)^(\s*\[[^\]]{1,12}\])+\s*|\s*(…|\.\.\.)\s*$|<[^>]{0,20}>|^\s+|\s+$"
#: Characters by which a damaged text may seem longer than the text it was.
SLACK = 3


@dataclass(frozen=True)
class Rule:
    """How the survivor of one field is found.

    ``usable``: which values may survive; ``priority``: higher is better (of the
    source the row came from, or of the value itself); among equals the latest row
    decides.  ``dated``: rows without a time stamp don't count.  ``reach``: what
    every value of the group, usable or not, shows the priority of the whole value
    to be; a survivor that falls short of it is incomplete.
    """

    field: str
    usable: Column
    priority: Column
    dated: bool = False
    reach: Column | None = None


def text_rule(field: str) -> Rule:
    """The complete and undamaged text: no mark of damage, not all capitals, then the longest."""
    v = F.col(field)
    shouting = (v == F.upper(v)) & (v != F.lower(v)) & (F.length(v) > 8)
    mended = F.regexp_replace(F.regexp_replace(v, REPAIRABLE, ""), r"&#?\w{1,8};|â€.|Ã.|\s+", "_")
    whole = F.length(mended).cast("long") - SLACK
    return Rule(field, F.coalesce(v.rlike(r"\S") & ~v.rlike(DAMAGE) & ~shouting, F.lit(False)), F.length(v).cast("long"), reach=whole)


def present_rule(field: str, priority: Column | None = None) -> Rule:
    v = F.col(field)
    return Rule(field, v.isNotNull() & F.coalesce(v.cast("string").rlike(r"\S"), F.lit(False)), F.lit(0).cast("long") if priority is None else priority)


def latest_rule(field: str) -> Rule:
    v = F.col(field)
    return Rule(field, F.coalesce(v >= 0, F.lit(False)), F.lit(0).cast("long"), dated=True)


def record_rules() -> tuple[Rule, ...]:
    """The rules for bibliographic records; a full card goes before one known from citations only."""
    full = F.when(F.coalesce(F.col("citation_only"), F.lit(False)), 0).otherwise(1).cast("long")
    return text_rule("title"), present_rule("link", full), present_rule("year", full), latest_rule("cited_by_count"), latest_rule("versions_count")


def survivor_rows(df: DataFrame, key: str = "cluster_id", at: Column | None = None, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """``key`` and, named like each field, STRUCT<value, differ>: the survivor (null if there is none) and whether the
    rows of the group differ in it as stored (null is a value of its own)."""
    at = iso_seconds(F.col("fetched_at")) if at is None else at
    rules = rules or record_rules()
    rows = df.where(F.col(f"`{key}`").isNotNull()).withColumn("__at", at)
    picks, out = [], []
    for k, r in enumerate(rules):
        v = F.col(f"`{r.field}`")
        usable = r.usable & F.col("__at").isNotNull() if r.dated else r.usable
        picks += [
            F.max(F.when(usable, F.struct(F.lit(True).alias("usable"), r.priority.alias("priority"), F.col("__at").alias("at"), v.alias("value")))).alias(f"__best{k}"),
            F.min(v).alias(f"__low{k}"), F.max(v).alias(f"__high{k}"), F.count(v).alias(f"__filled{k}"),
        ]
        if r.reach is not None:
            picks.append(F.max(r.reach).alias(f"__reach{k}"))
        best = F.col(f"__best{k}")
        whole = best["priority"] >= F.coalesce(F.col(f"__reach{k}"), F.lit(0)) if r.reach is not None else F.lit(True)
        differ = (F.col(f"__low{k}") != F.col(f"__high{k}")) | ((F.col(f"__filled{k}") > 0) & (F.col(f"__filled{k}") < F.col("__rows")))
        out.append(F.struct(F.when(whole, best["value"]).alias("value"), F.coalesce(differ, F.lit(False)).alias("differ")).alias(r.field))
    one = rows.groupBy(F.col(f"`{key}`").alias(key)).agg(F.count(F.lit(1)).alias("__rows"), *picks)
    return one.select(key, *out)


def survivors(df: DataFrame, key: str = "cluster_id", row_id: str = "obs_id", at: Column | None = None, rules: tuple[Rule, ...] | None = None, disputed: bool = False) -> DataFrame:
    """``key``, ``field``, ``value`` (text), ``differ``, and ``row_id``, the smallest that holds the value; with ``disputed``
    only the fields in which the rows of the group differ."""
    rules = rules or record_rules()
    one = survivor_rows(df, key, at, rules).withColumnsRenamed({r.field: f"__s{k}" for k, r in enumerate(rules)})
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{row_id}`").alias("__id"), *[F.col(f"`{r.field}`").alias(f"__v{k}") for k, r in enumerate(rules)]).where(F.col(key).isNotNull())
    wanted = [F.col(f"__s{k}.value").isNotNull() & (F.col(f"__s{k}.differ") if disputed else F.lit(True)) for k in range(len(rules))]
    held = rows.join(one.where(reduce(Column.__or__, wanted)), key)
    least = [F.min(F.when(w & (F.col(f"__v{k}") == F.col(f"__s{k}.value")), F.col("__id"))).alias(f"__id{k}") for k, w in enumerate(wanted)]
    found = held.groupBy(key).agg(*least, *[F.first(f"__s{k}").alias(f"__s{k}") for k in range(len(rules))])  # one and the same in every row of a group
    cells = [F.struct(F.lit(r.field).alias("field"), F.col(f"__s{k}.value").cast("string").alias("value"), F.col(f"__s{k}.differ").alias("differ"), F.col(f"__id{k}").alias(row_id)) for k, r in enumerate(rules)]
    return found.select(key, F.inline(F.array(*cells))).where(F.col(row_id).isNotNull())


def disputed_survivors(df: DataFrame, **kw) -> DataFrame:
    """Only the fields in which the rows of the group differ as stored."""
    return survivors(df, disputed=True, **kw)


def survivor_records(df: DataFrame, key: str = "cluster_id", rules: tuple[Rule, ...] | None = None, **kw) -> DataFrame:
    """One record per group, its fields typed as in the input; a group without any survivor has no record."""
    rules = rules or record_rules()
    one = survivor_rows(df, key, rules=rules, **kw).select(key, *[F.col(f"{r.field}.value").alias(r.field) for r in rules])
    return one.where(reduce(Column.__or__, [F.col(r.field).isNotNull() for r in rules]))
