"""ISO-8601 time stamps kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format: date, optional time of day, optional fraction, optional offset.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|z|[+-]\d{2}(:?\d{2})?)?)?$"


def iso_timestamp(text: Column) -> Column:
    """TIMESTAMP of an extended ISO-8601 text; without offset it is UTC; anything else is null."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"[T ].*(Z|z|[+-]\d{2}(:?\d{2})?)$"), F.upper(t)).otherwise(F.concat(t, F.when(t.rlike("[T ]"), "Z").otherwise("T00:00:00Z")))
    plain = F.regexp_replace(F.replace(zoned, F.lit(","), F.lit(".")), r"([+-]\d{2})(\d{2})?$", "$1:$2")
    plain = F.regexp_replace(plain, r":$", ":00")
    return F.when(t.rlike(ISO), F.try_to_timestamp(F.when(zoned.rlike(r"[+-]\d{2}(\d{2})?$"), plain).otherwise(zoned)))


def iso_seconds(text: Column) -> Column:
    """Whole seconds since 1970-01-01 UTC, or null."""
    return F.unix_seconds(iso_timestamp(text))
