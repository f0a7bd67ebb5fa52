"""History of changing attributes: a type-two dimension, merged snapshot by snapshot.

The dimension has closed versions and, for each entity, one open version, which
also tells the instant it was last seen.  A merge folds a snapshot to one row per
(entity, instant), carries missing values on from the open version, and compares
attribute hashes, the open version's first: where they differ the version is
closed with an end date and a new one is opened.  Closed versions are not read
again.  An update that is not later than the last sight of its entity can't be
placed by what the dimension holds (a value carried on looks like one observed),
so such entities are rebuilt from their observations.

A snapshot is windowed in time slices: within a slice values are carried by a
window; between slices only one summary row per (entity, slice) is windowed, so
that an entity that holds a third of all rows is worked on by many tasks and no
task ever sees more than one slice of it.

Defined results: rows without key or instant are left out; repeated rows and
rows of one instant count once (the greatest value of an attribute at an instant
holds); a null attribute says nothing and keeps the value before it; an empty
input gives an empty history; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WEEK = 7 * 86_400
#: Length of the snapshots a history is built of.
PERIOD = 52 * WEEK
CARRY, BEFORE, SLICE, AT = "__carry_{}", "__before_{}", "__slice", "__at"


def _hash(cols: list[Column]) -> Column:
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def _points(df: DataFrame, key: str, at: Column, attrs: dict[str, Column], slice_seconds: int) -> DataFrame:
    rows = df.select(F.col(f"`{key}`").alias("__key"), at.cast("long").alias(AT), *[c.alias(a) for a, c in attrs.items()])
    rows = rows.where(F.col("__key").isNotNull() & F.col(AT).isNotNull())
    rows = rows.withColumn(SLICE, F.floor(F.col(AT) / slice_seconds).cast("long"))
    return rows.groupBy("__key", SLICE, AT).agg(*[F.max(a).alias(a) for a in attrs])


def _opened(points: DataFrame, key: str, attrs: list[str]) -> DataFrame:
    """``key``, ``valid_from``, the attributes, ``attr_hash``: where the hash of the carried attributes
    differs from the one before it, or there is none."""
    inside = Window.partitionBy("__key", SLICE).orderBy(AT)
    running = points.select("__key", SLICE, AT, *[F.last(a, ignorenulls=True).over(inside).alias(CARRY.format(a)) for a in attrs])
    # One row per slice: what each attribute was last known to be, and that the slice has rows at all.
    tails = points.groupBy("__key", SLICE).agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), F.col(AT))).alias(a) for a in attrs])
    past = Window.partitionBy("__key").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.select(
        "__key", SLICE, *[F.last(a, ignorenulls=True).over(past).alias(BEFORE.format(a)) for a in attrs], F.count(F.lit(1)).over(past).alias("__earlier")
    )
    whole = running.join(heads, ["__key", SLICE])
    whole = whole.select("__key", SLICE, AT, "__earlier", *[F.col(BEFORE.format(a)) for a in attrs], *[F.coalesce(CARRY.format(a), BEFORE.format(a)).alias(a) for a in attrs])
    whole = whole.withColumn("attr_hash", _hash([F.col(a) for a in attrs]))
    before = F.when(F.col("__earlier") > 0, _hash([F.col(BEFORE.format(a)) for a in attrs]))
    whole = whole.withColumn("__prior", F.coalesce(F.lag("attr_hash").over(inside), before))
    opened = whole.where(F.col("__prior").isNull() | (F.col("__prior") != F.col("attr_hash")))
    return opened.select(F.col("__key").alias(key), F.col(AT).alias("valid_from"), *attrs, "attr_hash")


def close_versions(versions: DataFrame, key: str, slice_seconds: int = WEEK) -> DataFrame:
    """Adds ``valid_to`` (the next opening; null for the open version) and ``is_current``."""
    v = versions.withColumn(SLICE, F.floor(F.col("valid_from") / slice_seconds).cast("long"))
    inside = Window.partitionBy(key, SLICE).orderBy("valid_from")
    firsts = v.groupBy(key, SLICE).agg(F.min("valid_from").alias("__first"))
    firsts = firsts.withColumn("__next", F.lead("__first").over(Window.partitionBy(key).orderBy(SLICE))).drop("__first")
    v = v.withColumn("__lead", F.lead("valid_from").over(inside)).join(firsts, [key, SLICE])
    v = v.withColumn("valid_to", F.coalesce("__lead", "__next"))
    return v.withColumn("is_current", F.col("valid_to").isNull()).drop(SLICE, "__lead", "__next")


def merge_snapshot(current: DataFrame | None, points: DataFrame, key: str, attrs: list[str], slice_seconds: int = WEEK) -> DataFrame:
    """The rows that a snapshot changes: for each entity in ``points`` (later than its open version was last
    seen) its new versions and the one that was open, closed where a new one follows it."""
    names = ["valid_from", *attrs, "attr_hash"]
    seen = points.groupBy(F.col("__key").alias(key)).agg(F.max(AT).alias("seen_until"))
    if current is None:
        versions = _opened(points, key, attrs).select(key, *names)
    else:
        was = current.join(seen.select(key), key, "left_semi")
        base = was.select(F.col(key).alias("__key"), F.floor(F.col("seen_until") / slice_seconds).cast("long").alias(SLICE), F.col("seen_until").alias(AT), *attrs)
        opened = _opened(points.unionByName(base), key, attrs)
        fresh = opened.join(base.select(F.col("__key").alias(key), F.col(AT).alias("valid_from")), [key, "valid_from"], "left_anti")
        versions = fresh.select(key, *names).unionByName(was.select(key, *names))
    closed = close_versions(versions, key, slice_seconds).join(seen, key)
    return closed.select(key, "valid_from", "valid_to", *attrs, "attr_hash", "is_current", F.when(F.col("is_current"), F.col("seen_until")).alias("seen_until"))


def scd2_history(df: DataFrame, key: str, at: Column, attrs: dict[str, Column], slice_seconds: int = WEEK, period: int = PERIOD) -> DataFrame:
    """The dimension after merging ``df`` in snapshots of ``period`` seconds, in order of time: ``key``, ``valid_from``,
    ``valid_to`` (null: open), the attributes, ``attr_hash``, ``is_current``, ``seen_until`` (of open versions)."""
    points = _points(df, key, at, attrs, slice_seconds).withColumn("__snapshot", F.floor(F.col(AT) / period).cast("long"))
    points = materialize(points, by="__snapshot")
    merged: list[DataFrame] = []
    for n in sorted(r[0] for r in points.select("__snapshot").distinct().collect()):  # as many as periods
        snapshot = points.where(F.col("__snapshot") == n).drop("__snapshot")
        merged.append(materialize(merge_snapshot(_open_versions(merged, key, snapshot), snapshot, key, list(attrs), slice_seconds)))
    if not merged:
        return merge_snapshot(None, points.drop("__snapshot"), key, list(attrs), slice_seconds)
    return union_all([_open_versions(merged, key), *[m.where("not is_current") for m in merged]])


def _open_versions(merged: list[DataFrame], key: str, snapshot: DataFrame | None = None) -> DataFrame | None:
    """The open version of each entity (of ``snapshot``): that of the last merge that had it."""
    if not merged:
        return None
    found = union_all([m.where("is_current") for m in merged])
    if snapshot is not None:
        found = found.join(snapshot.select(F.col("__key").alias(key)).distinct(), key, "left_semi")
    rest = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.max_by(F.struct(*rest), "seen_until").alias("__v")).select(key, *[F.col(f"__v.{c}").alias(c) for c in rest])


def scd2_merge(
    dimension: DataFrame, updates: DataFrame, key: str, at: Column, attrs: dict[str, Column], observations: DataFrame | None = None, slice_seconds: int = WEEK, period: int = PERIOD
) -> DataFrame:
    """``dimension`` (as from :func:`scd2_history`) brought up to date.

    Entities without updates pass through; those whose updates are later than all
    that was seen of them are merged.  Entities with late updates are rebuilt from
    ``observations``, the rows the dimension was made of; without them a late
    update is an error.
    """
    points = materialize(_points(updates, key, at, attrs, slice_seconds))
    current = dimension.where("is_current")
    seen = current.select(F.col(key).alias("__key"), "seen_until")
    late = materialize(points.join(seen, "__key").where(F.col(AT) <= F.col("seen_until")).select("__key").distinct()).withColumnRenamed("__key", key)
    touched = points.select(F.col("__key").alias(key)).distinct()
    fresh = points.join(late.withColumnRenamed(key, "__key"), "__key", "left_anti")
    changed = merge_snapshot(current.join(late, key, "left_anti"), fresh, key, list(attrs), slice_seconds)
    kept = dimension.where("not is_current").join(late, key, "left_anti").unionByName(current.join(touched, key, "left_anti"))
    out = kept.unionByName(changed)
    if late.isEmpty():
        return out
    if observations is None:
        raise ValueError("updates not later than what was seen need the observations behind the dimension")
    columns = lambda df: df.select(key, at.cast("long").alias(AT), *[c.alias(a) for a, c in attrs.items()])
    again = columns(observations).unionByName(columns(updates)).join(late, key, "left_semi")
    return out.unionByName(scd2_history(again, key, F.col(AT), {a: F.col(a) for a in attrs}, slice_seconds, period))


def counted(column: str) -> Column:
    """A count that is missing or negative says nothing."""
    c = F.col(column)
    return F.when(c >= 0, c)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
