"""Sinks: JSON Lines, CSV, text, append without repeats, upsert, cursor and event stores."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.urls import redact_url
from .stores import last_per_key

JSON_OPTIONS = {"ignoreNullFields": "false"}


def record_line(fields: list[str], rest: str | None = None, extra_rest: str | None = None) -> Column:
    """A record as one JSON line, keys in the order given, nulls kept; then the keys of the map ``rest``
    and, inside ``extra``, those of ``extra_rest``."""
    json = lambda c: F.to_json(c, JSON_OPTIONS)
    inside = lambda text: F.substring(text, F.lit(2), F.length(text) - 2)
    if not rest and not extra_rest:
        return json(F.struct(*fields))
    parts = [inside(json(F.struct(f))) for f in fields if f != "extra"]
    if "extra" in fields:
        more = inside(json(F.col(extra_rest))) if extra_rest else F.lit(None).cast("string")
        known = inside(json(F.col("extra")))
        text = F.when(known.isNull() & more.isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), F.concat_ws(",", known, more), F.lit("}")))
        parts.insert(fields.index("extra"), F.concat(F.lit('"extra":'), text))
    if rest:
        parts.append(inside(json(F.col(rest))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def write_jsonl(df: DataFrame, path: str, order: str | None = None, fields: list[str] | None = None, single: bool = False) -> None:
    """One object per line, in order; ``single`` gives one file (for small results)."""
    fields = fields or [f.name for f in schema.RECORD.fields if f.name in df.columns]
    rest, extra_rest = (c if c in df.columns else None for c in (schema.REST, schema.EXTRA_REST))
    rows = df.orderBy(order) if order else df
    out = rows.select(record_line(fields, rest, extra_rest).alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def csv_rows(df: DataFrame) -> DataFrame:
    """The CSV columns as text: flags as ``True``/``False``, null as empty."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.when(F.col(c), "True").when(~F.col(c), "False") if kinds[c] == "boolean" else F.col(c).cast("string")
    return df.select(*[F.coalesce(cell(c), F.lit("")).alias(c) for c in schema.CSV_COLUMNS])


def write_csv(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    rows = csv_rows(df.orderBy(order) if order else df)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, header=True, escape='"', quote='"', lineSep="\r\n", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_text(df: DataFrame, column: str, path: str, order: str, single: bool = False) -> None:
    """One line per row, in order over the part files; ``single`` gives one file (for small results)."""
    rows = df.orderBy(order).select(column)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").text(path)


def upsert(stored: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Both, the last row of each key winning; rows of ``updates`` come after all stored ones."""
    names = stored.columns
    both = stored.select(*names).withColumn("__o", F.struct(F.lit(0).alias("side"), F.col(order).alias("o")))
    both = both.unionByName(updates.select(*names).withColumn("__o", F.struct(F.lit(1).alias("side"), F.col(order).alias("o"))))
    return last_per_key(both, key, "__o").select(*names)


def upsert_cursors(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Cursors brought up to date by signature; of several updates of one the latest ``updated_at`` holds."""
    return upsert(stored, updates, "signature", "updated_at")


def split_forgotten(cursors: DataFrame, pattern: str, readable: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): cursors whose signature or readable target contains ``pattern``, case folded."""
    from ..functions.text import casefold

    want = casefold(F.lit(pattern))
    hit = casefold(F.col("signature")).contains(want) | casefold(readable).contains(want)
    return cursors.where(~hit), cursors.where(hit)


def event_line(df: DataFrame) -> DataFrame:
    """Events as they are stored: URL redacted, wait to a tenth."""
    return df.select("at", "kind", redact_url(F.col("url")).alias("url"), "reason", "request_index", "consecutive", F.bround("waited", 1).alias("waited"), "outcome", "target", "saw")


def append_events(df: DataFrame, path: str) -> None:
    event_line(df).write.mode("append").json(path, ignoreNullFields=False)


def nearest_existing(path: str) -> Path:
    p = Path(path).absolute()
    while not p.exists():
        p = p.parent
    return p


def unwritable(path: str) -> str | None:
    """Why a local output path can't be written, None if it can; probed before any work."""
    near = nearest_existing(path)
    if near.is_dir() and not os.access(near, os.W_OK):
        return f"no permission to write in {near}"
    if near.is_file() and near != Path(path).absolute():
        return f"{near} is a file, not a folder"
    if near.is_dir() and near == Path(path).absolute() and any(near.iterdir()) and not (near / "_SUCCESS").exists():
        return f"{near} is a folder with other files"
    return None


def collisions(outputs: dict[str, str]) -> list[tuple[str, str]]:
    """Pairs of outputs that would overwrite each other."""
    seen: dict[Path, str] = {}
    out = []
    for role, path in outputs.items():
        at = Path(path).absolute()
        if at in seen:
            out.append((seen[at], role))
        seen.setdefault(at, role)
    return out
