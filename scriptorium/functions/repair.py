"""Typed repair of VARIANT values: strict about kinds, lenient about lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def as_number(v: Column) -> Column:
    """BIGINT of a whole number or of a text of digits; flags, fractions and the rest are null
    (so are numbers beyond 64 bits)."""
    text = F.trim(F.try_variant_get(v, "$", "string"))
    return F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")).when((_kind(v) == "STRING") & text.rlike(r"^-?\d+$"), text.try_cast("bigint"))


def as_flag(v: Column) -> Column:
    """Only true booleans survive."""
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def as_text(v: Column) -> Column:
    """A text, or a list joined by ``, ``; everything else is null."""
    many = F.array_join(F.transform(F.try_variant_get(v, "$", "array<string>"), lambda x: F.coalesce(x, F.lit("None"))), ", ")
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(_kind(v).startswith("ARRAY"), many)


def as_double(v: Column) -> Column:
    """DOUBLE of any number."""
    return F.when(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def absent(v: Column) -> Column:
    """No such key, or a JSON null."""
    return v.isNull() | (_kind(v) == "VOID")
