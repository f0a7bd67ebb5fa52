"""Bibliography entries out of records: keys, fields, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_fold, ascii_slug, filled, let, strip, surname
from .venues import entry_type, split_venue, venue_field

#: Title words that name nothing, and characters with a meaning in the format.
STOPWORDS = ("a", "an", "the", "on", "of", "in", "for", "and", "to", "with", "from", "by", "at", "is", "are")
ESCAPES = (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("^", r"\textasciicircum{}"), ("~", r"\textasciitilde{}"))

#: Letters behind a base run from ``a`` to the last character, past the numbers kept for halves of pairs, which are no characters.
FIRST, LAST, HALVES, PAIRS = ord("a"), 0x10FFFF, 0xD800, 0xE000
LETTERS = LAST - FIRST + 1 - (PAIRS - HALVES)


def escape(c: Column) -> Column:
    """Safe inside a braced field: braces to parentheses, backslash to slash, then the escapes."""
    t = F.translate(c, "{}\\", "()/")
    for a, b in ESCAPES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def bibtex_key(entry: Column) -> Column:
    """Citation key of an entry, null without a header."""
    return filled(F.regexp_extract(entry, r"@\w+\s*\{\s*([^,\s]+)\s*,", 1))


def letter_number(c: Column) -> Column:
    """Number of the first character of a text, 1 for ``a``; below 1 for what stands before it."""
    at = F.ascii(c).cast("long")
    return at - FIRST + 1 - F.when(at >= PAIRS, PAIRS - HALVES).otherwise(0)


def key_suffix(n: Column) -> Column:
    """What stands behind a base: nothing for 0, then one letter after another; after the last letter they begin anew behind it."""
    k = n.cast("long") - 1
    at = k % LETTERS + FIRST
    at = at + F.when(at >= HALVES, PAIRS - HALVES).otherwise(0)
    pair = F.concat(F.hex(F.shiftright(at - 0x10000, 10) + HALVES), F.hex((at - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    letter = F.decode(F.unhex(F.when(at < 0x10000, F.lpad(F.hex(at), 4, "0")).otherwise(pair)), "utf-16be")
    return F.when(n == 0, "").otherwise(F.concat(F.repeat(F.lit(chr(LAST)), F.floor(k / LETTERS).cast("int")), letter))


def suffix_number(suffix: Column) -> Column:
    """The number that :func:`key_suffix` made it of."""
    return F.when(suffix == "", F.lit(0).cast("long")).otherwise((F.length(suffix) - 1).cast("long") * LETTERS + letter_number(F.right(suffix, F.lit(1))))


def parse_bibtex(body: Column) -> Column:
    """The entry in an export (rendered page or raw), from its ``@``; null if there is none."""
    page = F.lower(body).contains("<pre") | F.lower(body).contains("<html")
    inner = F.regexp_replace(F.regexp_extract(body, r"(?is)<pre[^>]*>(.*?)</pre>", 1), "<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        inner = F.replace(inner, F.lit(a), F.lit(b))
    text = F.when(page, inner).otherwise(body)
    start = F.instr(text, "@")
    entry = F.when(start > 0, F.substring(text, start, F.length(text)))
    return F.when(entry.contains("{"), strip(entry))


def _unmark(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^…|…$", ""), r"^\.\.\.|\.\.\.$", ""))


def authors_raw(authors: Column, byline: Column) -> Column:
    return strip(F.coalesce(filled(authors), filled(F.get(F.split(F.coalesce(byline, F.lit("")), " - "), F.lit(0))), F.lit("")))


def authors_cut(authors: Column, byline: Column) -> Column:
    return let(authors_raw(authors, byline), lambda raw: raw.endswith("…") | raw.endswith("..."))


def authors_field(authors: Column, byline: Column) -> Column:
    """Names joined by ``and``, ``others`` last where the list was cut."""
    names = F.filter(F.transform(F.split(authors_raw(authors, byline), ","), _unmark), lambda x: x != "")
    return F.array_join(F.when(authors_cut(authors, byline), F.array_append(names, F.lit("others"))).otherwise(names), " and ")


def base_key(authors: Column, byline: Column, year: Column, title: Column, stored: Column) -> Column:
    """The stored key, else surname, year and first telling title word."""
    line = F.coalesce(filled(authors), filled(byline), F.lit(""))
    name = F.coalesce(filled(ascii_slug(F.coalesce(let(line, lambda x: surname(x, x)), F.lit("")))), F.lit("anon"))
    words = F.regexp_extract_all(ascii_fold(F.coalesce(title, F.lit(""))), F.lit(r"((?U:[\w'])+)"), F.lit(1))
    words = F.transform(words, lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    telling = F.get(F.filter(words, lambda w: ~w.isin(*STOPWORDS)), F.lit(0))
    made = F.concat(name, F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("")), F.coalesce(telling, F.lit("")))
    return F.coalesce(filled(stored), made)


def entry(key: Column, title: Column, authors: Column, byline: Column, venue: Column, year: Column, link: Column, count: Column, site: str) -> Column:
    """The text of an entry; empty fields are left out.  ``site`` names where the count was seen."""
    known = F.struct(
        entry_type(venue).alias("kind"), split_venue(F.coalesce(venue, F.lit(""))).alias("v"), escape(authors_field(authors, byline)).alias("authors"), escape(venue_field(venue)).alias("venue")
    )
    return let(known, lambda k: _entry(k, key, title, year, link, count, site))


def _entry(known: Column, key: Column, title: Column, year: Column, link: Column, count: Column, site: str) -> Column:
    kind, v = known["kind"], known["v"]
    pair = lambda n, value: F.when(filled(value).isNotNull(), F.concat(F.lit("  "), n if isinstance(n, Column) else F.lit(n), F.lit(" = {"), value, F.lit("},\n")))
    fields = [
        F.concat(F.lit("  title = {{"), escape(F.coalesce(title, F.lit(""))), F.lit("}},\n")),
        pair("author", known["authors"]),
        pair(F.when(kind == "inproceedings", "booktitle").otherwise("journal"), known["venue"]),
        pair("volume", escape(v["volume"])), pair("number", escape(v["number"])), pair("pages", escape(v["pages"])),
        pair("year", F.nullif(year, F.lit(0)).cast("string")), pair("url", escape(link)),
        pair("note", F.concat(F.lit("cited by "), count.cast("string"), F.lit(f" on {site}"))),
    ]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws("", *fields), F.lit("}\n"))
