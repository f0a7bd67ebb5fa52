"""Text expressions: folding, clipping, numbers in labels, bylines."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two marks of omission.
ELLIPSIS, DOTS = "…", "..."
#: Runs of digits with their grouping, and a year that is no part of an identifier.
GROUPED_INT = r"\d[\d,.\s\x{A0}]*"
YEAR = r"(?<![\d:.])(?U:\b)(1[89]\d{2}|20\d{2})(?U:\b)(?![.\d])"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def filled(c: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^(?U:\s)+|(?U:\s)+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, none before ``, ; .``, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U:\s)+", " "), r"\s+([,;.])", "$1"))


@lru_cache(1)
def _fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Where case folding differs from lower casing: letters one for one, and letters that grow."""
    one, to, grow = ["Σ"], ["σ"], []  # lower casing knows a final form
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if 0xD800 <= k < 0xE000 or c.casefold() == c.lower():
            continue
        f = c.casefold()
        if len(f) == 1 and len(c.lower()) == 1 and c.lower() == c:
            one.append(c)
            to.append(f)
        elif c.lower() == c or len(f) > 1:
            grow.append((c, f))
    return "".join(one), "".join(to), tuple(grow)


def casefold(c: Column) -> Column:
    """Full Unicode case folding, from a table derived from the character database."""
    one, to, grow = _fold_table()
    wide = "[" + "".join(x for x, _ in grow) + "]"
    longer = F.map_from_arrays(F.lit([x for x, _ in grow]), F.lit([f for _, f in grow]))
    spelled = lambda v: F.array_join(F.transform(F.split(v, ""), lambda x: F.coalesce(F.try_element_at(longer, x), x)), "")
    full = lambda v: F.lower(F.translate(F.when(v.rlike(wide), spelled(v)).otherwise(v), one, to))
    return let(c, lambda v: F.when(v.rlike(NOT_ASCII), full(v)).otherwise(F.lower(v)))


NOT_ASCII = r"[^\x00-\x7F]"
#: Letters without a decomposition, and what they are written as.
TRANSLITERATIONS = {"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d"}


@lru_cache(1)
def _plain_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII letter or digit and marks."""
    src, dst = [], []
    for k in range(0x80, 0x2200):
        c = chr(k)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare.isascii() and bare.isalnum():
            src.append(c)
            dst.append(bare.lower())
    return "".join(src), "".join(dst)


def ascii_fold(c: Column) -> Column:
    """Case-folded, accents dropped; other characters stay."""
    src, dst = _plain_table()

    def full(v: Column) -> Column:
        t = casefold(v)
        for a, b in TRANSLITERATIONS.items():
            t = F.replace(t, F.lit(a), F.lit(b))
        return F.regexp_replace(F.translate(t, src, dst), r"\p{M}", "")

    return let(c, lambda v: F.when(v.rlike(NOT_ASCII), full(v)).otherwise(F.lower(v)))


def ascii_slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits of a text, accents dropped."""
    return F.regexp_replace(ascii_fold(c), "[^a-z0-9]", "")


def clip(c: Column, width: int) -> Column:
    """At most ``width`` characters; a longer text ends in an ellipsis."""
    if width < 2:
        raise ValueError("clip needs room for one character and the ellipsis")
    cut = F.concat(F.regexp_replace(F.substring(c, 1, width - 1), r"(?U:\s)+$", ""), F.lit(ELLIPSIS))
    return F.when(F.length(c) <= width, c).otherwise(cut)


def counted(n: Column, noun: str) -> Column:
    """``1 record``, ``1,234 records``."""
    return F.concat(F.format_number(n, 0), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def all_ints(c: Column) -> Column:
    """Every whole number of a label, digit grouping ignored (64 bits; longer ones are dropped)."""
    runs = F.regexp_extract_all(c, F.lit(f"({GROUPED_INT})"), F.lit(1))
    numbers = F.transform(runs, lambda x: F.regexp_replace(x, "[^0-9]", "").try_cast("bigint"))
    return F.filter(numbers, lambda x: x.isNotNull())


def first_int(c: Column) -> Column:
    return F.regexp_replace(filled(F.regexp_extract(c, f"({GROUPED_INT})", 1)), "[^0-9]", "").try_cast("bigint")


def strip_tag(c: Column) -> Column:
    """A title without a short tag in brackets before it."""
    return F.regexp_replace(c, r"^\s*\[[^\]]{1,12}\]\s*", "")


def strip_year(c: Column) -> Column:
    """A venue text without its year and the separators left dangling; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(c, YEAR, ""), r"\s*([-–,])\s*(?=[-–,]|$)", "")
    return filled(F.regexp_replace(bare, r"^[ ,\-–]+|[ ,\-–]+$", ""))


def split_byline(c: Column) -> Column:
    """STRUCT<authors, venue, year> of "authors - venue, year - host"."""
    parts = F.transform(F.split(c, " - "), strip)
    middle = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    year = F.coalesce(filled(F.regexp_extract(middle, YEAR, 1)), filled(F.regexp_extract(c, YEAR, 1)))
    has = filled(c).isNotNull()
    return F.struct(
        F.when(has, filled(F.get(parts, F.lit(0)))).alias("authors"), F.when(has, strip_year(middle)).alias("venue"), F.when(has, year.cast("bigint")).alias("year")
    )


def first_author(authors: Column, byline: Column) -> Column:
    """First name of the author list (or of the byline), without marks; null if there is none."""
    line = F.get(F.split(F.coalesce(filled(authors), byline), " - "), F.lit(0))
    first = strip(F.get(F.split(line, ","), F.lit(0)))
    return filled(strip(F.regexp_replace(first, "^…+|…+$", "")))


def surname(authors: Column, byline: Column) -> Column:
    """Last word of the first author."""
    return filled(F.element_at(F.split(first_author(authors, byline), r"(?U:\s)+"), -1))
