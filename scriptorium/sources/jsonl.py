"""JSON Lines read leniently: typed, ordered records with counters of what was repaired."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import repair


def parse_lines(lines: DataFrame, value: str = "value", order: str = "ord") -> DataFrame:
    """``order``, the record fields, the keys beyond them (:data:`schema.REST`, :data:`schema.EXTRA_REST`),
    ``malformed`` and ``repaired`` for every line that is not blank.

    A line that is no JSON object is malformed (all fields null).  A field of the
    wrong kind is repaired or nulled, and the record counts as repaired.
    """
    v = F.try_parse_json(F.col(value))
    rows = lines.where(F.col(value).rlike(r"\S")).select(F.col(order).alias(order), v.alias("v"))
    rows = rows.withColumn("malformed", F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True)))
    get = lambda name: F.try_variant_get(F.col("v"), f"$.{name}", "variant")
    fields, changed = [], []
    for f in schema.RECORD.fields:
        raw = get(f.name)
        if f.name == "extra":
            extra = F.struct(*[(repair.as_number(get(f"extra.{e.name}")) if e.name == "follow_depth" else repair.as_text(get(f"extra.{e.name}"))).alias(e.name) for e in f.dataType.fields])
            is_object = F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))
            fields.append(F.when(is_object, extra).alias("extra"))
            changed.append(~repair.absent(raw) & ~is_object)
            continue
        if f.name in schema.NUMBERS:
            good, kind = repair.as_number(raw), "BIGINT"
        elif f.name in schema.FLAGS:
            good, kind = repair.as_flag(raw), "BOOLEAN"
        else:
            good, kind = repair.as_text(raw), "STRING"
        fields.append(good.alias(f.name))
        if f.name in (*schema.NUMBERS, *schema.FLAGS, *schema.TEXTS):
            changed.append(~repair.absent(raw) & (F.schema_of_variant(raw) != kind))
    fields += [_rest(F.col("v"), schema.RECORD).alias(schema.REST), _rest(get("extra"), schema.RECORD["extra"].dataType).alias(schema.EXTRA_REST)]
    repaired = changed[0]
    for c in changed[1:]:
        repaired = repaired | c
    return rows.select(order, *fields, "malformed", (~F.col("malformed") & F.coalesce(repaired, F.lit(False))).alias("repaired"))


def _rest(v: Column, known: T.StructType) -> Column:
    """The keys of an object that are not ``known``, with their values as they are; null if there are none."""
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(known.names))
    return F.when(F.size(rest) > 0, rest)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``ord`` (file in the order given, place in it) and ``value`` of every line; a path may be a folder of part files."""
    if not paths:
        raise ValueError("no input files")
    text = spark.read.text(paths)
    given = {_plain(p): k for k, p in reversed(list(enumerate(paths)))}
    ranked = []
    for uri in text.inputFiles():
        at = _plain(uri)
        while at not in given and "/" in at:
            at = at.rsplit("/", 1)[0]
        ranked.append((given.get(at, len(paths)), uri))
    files = spark.createDataFrame([(re.sub("/+", "/", unquote(uri)), k) for k, (_, uri) in enumerate(sorted(ranked))], "path string, file long")
    # Spark spells the same file in two ways: file:///a and file:/a.
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/+", "/")
    lines = text.select("value", path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    place = F.struct("file", "block", F.shiftright("line", 33).alias("part"), "line").alias("ord")  # the id holds the task in its upper bits
    return lines.join(files, "path").select(place, "value")


def _plain(path: str) -> str:
    """A path or URI as a bare path, for comparing."""
    parts = urlsplit(path) if "://" in path or path.startswith("file:") else None
    if parts is None:
        return str(Path(path).absolute())
    return unquote(parts.path).rstrip("/") if parts.scheme == "file" else unquote(path).rstrip("/")


def number_lines(records: DataFrame) -> DataFrame:
    """``ord`` as one whole number, in order of (file, place in it); only one row for each piece of a file is sorted."""
    at = ["file", "block", "part"]
    flat = records.select(*[F.col(f"ord.{c}").alias(f"__{c}") for c in (*at, "line")], *[c for c in records.columns if c != "ord"])
    keys = [f"__{c}" for c in at]
    pieces = flat.groupBy(*keys).agg(F.min("__line").alias("__low"), (F.max("__line") - F.min("__line") + 1).alias("__lines"))
    before = F.sum("__lines").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*keys, (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__shift"))
    return flat.join(pieces, keys).select((F.col("__line") + F.col("__shift")).alias("ord"), *[c for c in records.columns if c != "ord"])


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of the files, first to last; ``malformed`` rows are kept for the counters."""
    return parse_lines(read_lines(spark, paths))


def scan_counts(parsed: DataFrame) -> DataFrame:
    """``records``, ``unreadable_lines``, ``repaired_records`` in one pass."""
    return parsed.agg(F.count_if(~F.col("malformed")).alias("records"), F.count_if("malformed").alias("unreadable_lines"), F.count_if("repaired").alias("repaired_records"))


def folder_files(folder: str, exclude: list[str] | None = None) -> list[str]:
    """The folder's own ``*.jsonl`` by name, without the files a run writes itself."""
    out = {Path(p).resolve() for p in exclude or []}
    return [str(p) for p in sorted(Path(folder).iterdir()) if p.suffix == ".jsonl" and p.is_file() and p.resolve() not in out]


def resolve_inputs(folder: str | None, files: list[str], exclude: list[str] | None = None) -> list[str]:
    """Folder files first, then the named ones; none at all is an error."""
    found = (folder_files(folder, exclude) if folder else []) + list(files)
    if not found:
        raise ValueError("bad_inputs: no input files")
    return found


def target_list(spark: SparkSession, given: list[str], path: str | None = None) -> DataFrame:
    """``ord`` and ``value`` of the targets: those given, then those of the list file; repeats stay.  A list file
    without any target is an error."""
    parts = [spark.createDataFrame([(k, v) for k, v in enumerate(given)], "ord long, value string")]
    if path is not None:
        listed = number_lines(list_items(read_lines(spark, [path])))
        if listed.isEmpty():
            raise ValueError(f"{path} names no target: every line is blank or a comment")
        parts.append(listed.select((F.col("ord") + len(given)).alias("ord"), "value"))
    return reduce(DataFrame.unionByName, parts)


def list_items(lines: DataFrame, value: str = "value") -> DataFrame:
    """A list file's items: trimmed, without blank lines and ``#`` comments."""
    t = F.trim(F.col(value))
    return lines.where((t != "") & ~t.startswith("#")).withColumn(value, t)
