"""Venue strings read apart: name, volume, issue, pages, and whether an end was cut."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DOTS, ELLIPSIS, filled, let, strip

#: Fixed value: numeric tail of a venue: volume (issue), pages, year.
TAIL = r"\s+(\d+)(?:\s*\(([^)]*)\))?(?:,\s*(\d+\s*[-–]\s*\d+|\d+))?(?:,\s*((?:19|20)\d{2}))?\s*$"
#: Words that make a venue a conference.
PROCEEDINGS = r"(?i)(?U:\b)(proceedings|conference|workshop|symposium|congress|meeting)(?U:\b)"


def _edges(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ ,.]+|[ ,.]+$", "")


def _begins(c: Column) -> Column:
    return c.startswith(ELLIPSIS) | c.startswith(DOTS)


def _ends(c: Column) -> Column:
    return c.endswith(ELLIPSIS) | c.endswith(DOTS)


def split_venue(venue: Column) -> Column:
    """STRUCT<name, volume, number, pages, cut_head, cut_tail>; null stays null."""
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"^…|…$", ""), r"^\.\.\.|\.\.\.$", "")

    def parts(p: Column) -> Column:
        cleaned = p["cleaned"]
        part = lambda k: F.regexp_extract(cleaned, TAIL, k)
        return F.struct(
            F.coalesce(filled(_edges(F.regexp_replace(cleaned, TAIL, ""))), cleaned).alias("name"),
            filled(part(1)).alias("volume"),
            filled(strip(part(2))).alias("number"),
            filled(F.replace(part(3), F.lit(" "), F.lit(""))).alias("pages"),
            p["cut_head"].alias("cut_head"),
            p["cut_tail"].alias("cut_tail"),
        )

    read = let(strip(venue), lambda t: F.struct(_edges(bare(t)).alias("cleaned"), _begins(t).alias("cut_head"), _ends(t).alias("cut_tail")))
    return F.when(venue.isNotNull(), let(read, parts))


def normalize_venue(venue: Column) -> Column:
    """One label per venue: preprints without their number, cut names with their mark."""

    def label(v: Column) -> Column:
        cut = v["cut_head"] | v["cut_tail"]
        marked = F.concat_ws(" ", F.when(v["cut_head"], ELLIPSIS), v["name"], F.when(v["cut_tail"], ELLIPSIS))
        return (
            F.when(v.isNull(), None)
            .when(v["name"].rlike(r"(?i)^arxiv preprint(?U:\b)"), "arXiv preprint")
            .when(v["name"] == "", F.when(cut, ELLIPSIS).otherwise(""))
            .otherwise(marked)
        )

    return let(split_venue(venue), label)


def venue_field(venue: Column) -> Column:
    """The venue's name as a bibliography prints it: ASCII mark where it was cut."""

    def printed(v: Column) -> Column:
        name = strip(F.regexp_replace(v["name"], r"(?i)\s+arxiv$", ""))
        return let(name, lambda n: F.when((n == "") | (n != v["name"]) | ~(v["cut_head"] | v["cut_tail"]), n).otherwise(F.concat(n, F.lit(" ..."))))

    return let(split_venue(F.coalesce(venue, F.lit(""))), printed)


def entry_type(venue: Column) -> Column:
    return let(venue_field(venue), lambda f: F.when(f == "", "misc").when(f.rlike(PROCEEDINGS), "inproceedings").otherwise("article"))
