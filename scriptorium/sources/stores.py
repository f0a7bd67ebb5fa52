"""Event logs, cursor files, profile stores and bibliographies as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import repair
from ..functions.text import filled

REHEARSAL = "rehearsal"


def parse_events(lines: DataFrame, value: str = "value", order: str = "ord") -> DataFrame:
    """Event records with their defaults, and ``unreadable`` for lines that are no object."""
    rows = lines.where(F.col(value).rlike(r"\S")).select(order, F.try_parse_json(F.col(value)).alias("v"))
    rows = rows.withColumn("unreadable", F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True)))
    get = lambda n: F.try_variant_get(F.col("v"), f"$.{n}", "variant")
    text = lambda n, d: F.coalesce(filled(repair.as_text(get(n))), F.lit(d)).alias(n)
    number = lambda n, d: F.coalesce(F.nullif(repair.as_number(get(n)), F.lit(0)), F.lit(d)).cast("long").alias(n)
    saw = get("saw")
    seen = F.when(F.schema_of_variant(saw).startswith("ARRAY"), F.transform(F.try_variant_get(saw, "$", "array<string>"), lambda x: F.coalesce(filled(x), F.lit("?"))))
    return rows.select(
        order, text("at", ""), text("kind", "?"), text("url", ""), text("reason", ""), number("request_index", 0), number("consecutive", 1),
        F.coalesce(repair.as_double(get("waited")), F.lit(0.0)).alias("waited"), text("outcome", "?"), text("target", ""),
        F.coalesce(seen, F.array().cast("array<string>")).alias("saw"), "unreadable",
    )


def is_drill(outcome: Column, target: Column) -> Column:
    """A rehearsal, not a real block."""
    return F.coalesce(outcome == "rehearsed", F.lit(False)) | F.coalesce(target == REHEARSAL, F.lit(False))


def parse_cursors(files: DataFrame, value: str = "value") -> DataFrame:
    """``signature``, ``next_start``, ``exhausted``, ``updated_at``, ``repaired`` of state files read
    whole.  A file that is no object is an error; an entry that is none is dropped and counted
    with :func:`cursor_counts`."""
    v = F.try_parse_json(F.col(value))
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    checked = F.when(ok, F.try_variant_get(v, "$", "map<string,variant>")).otherwise(F.raise_error(F.lit("state_unreadable: the file holds no object")).cast("map<string,variant>"))
    rows = files.select(F.explode(checked).alias("signature", "e"))
    get = lambda n: F.try_variant_get(F.col("e"), f"$.{n}", "variant")
    entry = F.coalesce(F.schema_of_variant("e").startswith("OBJECT"), F.lit(False))
    odd = (
        (~repair.absent(get("next_start")) & (F.schema_of_variant(get("next_start")) != "BIGINT"))
        | (~repair.absent(get("exhausted")) & (F.schema_of_variant(get("exhausted")) != "BOOLEAN"))
        | (~repair.absent(get("updated_at")) & (F.schema_of_variant(get("updated_at")) != "STRING"))
    )
    return rows.select(
        "signature", F.coalesce(repair.as_number(get("next_start")), F.lit(0)).cast("long").alias("next_start"), F.coalesce(repair.as_flag(get("exhausted")), F.lit(False)).alias("exhausted"),
        F.coalesce(repair.as_text(get("updated_at")), F.lit("")).alias("updated_at"), F.coalesce(odd, F.lit(False)).alias("repaired"), (~entry).alias("dropped"),
    )


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key (a store read back: the last row wins)."""
    names = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in names])


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    names = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in names])


def bibliography_keys(text: Column) -> Column:
    """Citation keys of a ``.bib`` text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?:^|\n)@\w+\s*\{\s*([^,\s]+)\s*,"), F.lit(1))
