"""Keyed merge: one record per work out of all its observations, the richest winning.

The merge is a left fold in order of arrival: the later row wins if its rank,
(count or -1, filled fields), is strictly greater than that of the record so
far, and the loser fills what the winner lacks.  The rank of the record so far
needs no fold: its count is the running maximum of the counts there were (a
missing one never takes the place of a negative one), and the fields it has filled
are the running union.  So the winners follow from a prefix scan, and each field
is the one of the last winner that has it, else of the first loser that has it -
keyed aggregations that combine before the shuffle.  The scan runs in slices of
the order, so no task gathers the rows of one work.

Defined results: a zero count ranks like a missing one; ties keep the earlier
row; a null key is left out; an empty table gives no row; columns that are not
named in ``fields`` are left out.

Keys no schema names come as a map: each counts as a field, so the first row in
which a key is filled adds one to the union from then on, and each is picked by
itself, keyed by (key, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE, BITS = 100_000, 62


def is_filled(c: Column, kind: T.DataType) -> Column:
    """Not null, not the empty text, not the empty list; zero and false are filled."""
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def _entries(rows: DataFrame, key: str, order: str, rest: str, *more: str) -> DataFrame:
    """``__name``, ``__value`` and ``__has`` (filled) of the map ``rest``, one row per entry."""
    e = rows.select(key, order, *more, F.explode(rest).alias("__name", "__value"))
    return e.withColumn("__has", ~F.coalesce(F.to_json("__value"), F.lit("null")).isin("null", '""', "[]"))


def mark_winners(df: DataFrame, key: str, order: str, count: str, fields: list[str], slice_rows: int = SLICE, rest: str | None = None) -> DataFrame:
    """``df`` with ``__wins`` where the row wins over the record merged so far (the first row does);
    the entries of the map ``rest`` count as fields."""
    types = {f.name: f.dataType for f in df.schema.fields}
    has = [F.when(is_filled(F.col(f), types[f]), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for f in fields]
    filled = F.lit(0).cast("long")
    for h in has:
        filled = filled + h
    masks = {}  # one bit a field, BITS to a number
    for k in range(0, len(has), BITS):
        mask = F.lit(0).cast("long")
        for j, h in enumerate(has[k : k + BITS]):
            mask = mask.bitwiseOR(F.shiftleft(h, j))
        masks[f"__mask{k // BITS}"] = mask
    known = F.when(F.col(count).isNotNull(), F.coalesce(F.nullif(F.col(count), F.lit(0)), F.lit(-1)).cast("long"))
    rows = df.where(F.col(key).isNotNull()).withColumns({"__c": known, **masks, "__filled": filled, "__slice": F.floor(F.col(order) / slice_rows).cast("long")})
    if rest:
        has = _entries(rows, key, order, rest).where("__has")
        own = has.groupBy(key, order).agg(F.count(F.lit(1)).alias("own"), F.lit(0).cast("long").alias("new"))
        new = has.groupBy(key, "__name").agg(F.min(order).alias(order)).groupBy(key, order).agg(F.lit(0).cast("long").alias("own"), F.count(F.lit(1)).alias("new"))
        both = own.unionByName(new).groupBy(key, order).agg(F.sum("own").alias("__own"), F.sum("new").alias("__new"))
        rows = rows.join(both, [key, order], "left").withColumns({"__filled": F.col("__filled") + F.coalesce("__own", F.lit(0)), "__new": F.coalesce("__new", F.lit(0))}).drop("__own")
    else:
        rows = rows.withColumn("__new", F.lit(0).cast("long"))
    past = Window.partitionBy(key, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(key, "__slice").agg(F.max("__c").alias("c"), *[F.bit_or(m).alias(f"{m}s") for m in masks], F.sum("__new").alias("n"), F.count(F.lit(1)).alias("r"))
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(key, "__slice", F.max("c").over(earlier).alias("__c0"), *[F.bit_or(f"{m}s").over(earlier).alias(f"{m}e") for m in masks], F.sum("n").over(earlier).alias("__n0"), F.sum("r").over(earlier).alias("__r0"))
    running = {"__c1": F.max("__c").over(past), **{f"{m}p": F.bit_or(m).over(past) for m in masks}, "__n1": F.sum("__new").over(past), "__r1": F.count(F.lit(1)).over(past)}
    rows = rows.withColumns(running).join(slices, [key, "__slice"])
    top, own = F.coalesce(F.greatest("__c0", "__c1"), F.lit(-1)), F.coalesce("__c", F.lit(-1))
    union = F.coalesce("__n0", F.lit(0)) + F.coalesce("__n1", F.lit(0))
    for m in masks:
        union = union + F.bit_count(F.coalesce(f"{m}e", F.lit(0)).bitwiseOR(F.coalesce(f"{m}p", F.lit(0))))
    first = (F.coalesce("__r0", F.lit(0)) == 0) & (F.col("__r1") == 0)
    wins = first | (own > top) | ((own == top) & (F.col("__filled") > union))
    made = [x for m in masks for x in (m, f"{m}e", f"{m}p")]
    return rows.withColumn("__wins", wins).drop("__c", *made, "__filled", "__slice", "__c0", "__c1", "__new", "__n0", "__n1", "__r0", "__r1")


def _merged_map(rows: DataFrame, key: str, order: str, column: str, overlay: bool) -> DataFrame:
    """``key`` and the map ``column`` of the merged record.

    ``overlay``: a key the winner has stays, whatever its value; else an empty value
    gives way to the loser's, even to another empty one.
    """
    e = _entries(rows, key, order, column, "__wins")
    has, wins = F.lit(True) if overlay else F.col("__has"), F.col("__wins")
    won, lost = F.when(has & wins, F.col(order)), F.when(has & ~wins, F.col(order))
    value = F.when(F.max(won).isNotNull(), F.max_by("__value", won)).when(F.min(lost).isNotNull(), F.min_by("__value", lost))
    if not overlay:
        late = F.when(~wins, F.col(order))
        value = value.when(F.max(late).isNotNull(), F.max_by("__value", late)).otherwise(F.min_by("__value", order))
    one = e.groupBy(key, "__name").agg(value.alias("__value"))
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__name", "__value"))).alias(column))


def merge_richest(df: DataFrame, key: str, order: str, count: str, fields: list[str], extra: str | None = None, least: tuple[str, ...] = ("follow_depth",), rest: str | None = None, extra_rest: str | None = None) -> DataFrame:
    """One row per ``key``: ``order`` (of its first row), ``n_rows``, the merged ``fields`` and,
    if there is an object column ``extra``, its parts (those named in ``least`` by minimum); the maps
    ``rest`` and ``extra_rest`` of further keys, of the record and of ``extra``, are merged likewise."""
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = mark_winners(df, key, order, count, fields, rest=rest)

    def pick(c: Column, filled: Column) -> Column:
        won = F.max_by(c, F.when(filled & F.col("__wins"), F.col(order)))
        lost = F.min_by(c, F.when(filled & ~F.col("__wins"), F.col(order)))
        any_won = F.count_if(filled & F.col("__wins")) > 0
        return F.when(any_won, won).otherwise(F.when(F.count_if(filled) > 0, lost))

    out = [pick(F.col(f), is_filled(F.col(f), types[f])).alias(f) for f in fields]
    if extra:
        parts = [F.min(f"{extra}.{p.name}").alias(p.name) if p.name in least else pick(F.col(f"{extra}.{p.name}"), F.col(f"{extra}.{p.name}").isNotNull()).alias(p.name) for p in types[extra].fields]
        whole = F.struct(*parts)
        out.append(F.when((F.count(F.lit(1)) > 1) | (F.count(extra) > 0), whole).alias(extra))
    merged = rows.groupBy(key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_rows"), *out)
    for column, overlay in ((rest, False), (extra_rest, True)):
        if column:
            merged = merged.join(_merged_map(rows, key, order, column, overlay), key, "left")
    return merged


def new_rows(df: DataFrame, key: str, order: str, stored: DataFrame) -> DataFrame:
    """The first row of each key that is not stored yet (append without repeats)."""
    fresh = df.join(stored.select(key).distinct(), key, "left_anti")
    names = [c for c in df.columns if c != key]
    best = fresh.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in names])
