"""Schemas of the data model: records, profiles, events, cursors."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()

#: Fixed values of the file format, here and below: fields of a record in order of writing; ``extra`` is an object.
RECORD = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("cluster_id", _S), ("position", _L), ("title", _S), ("link", _S), ("resource_link", _S), ("resource_type", _S), ("byline", _S),
            ("authors", _S), ("venue", _S), ("year", _L), ("snippet", _S), ("cited_by_count", _L), ("cited_by_url", _S), ("versions_count", _L),
            ("versions_url", _S), ("related_url", _S), ("citation_only", _B), ("query", _S), ("page_start", _L), ("fetched_at", _S),
        )
    ]
    + [T.StructField("extra", T.StructType([T.StructField("follow_depth", _L), T.StructField("bibtex_key", _S), T.StructField("citation_id", _S)]))]
)
#: Columns for the keys a record has beyond these, at its top and inside ``extra``: MAP<STRING, VARIANT>, null if there are none.
REST, EXTRA_REST = "rest", "extra_rest"
#: Repaired on read as whole numbers; as texts (lists are joined); as flags.
NUMBERS = ("year", "cited_by_count", "versions_count", "position", "page_start")
TEXTS = ("authors", "byline")
FLAGS = ("citation_only",)

#: Columns of the CSV form in order (``byline`` and ``extra`` stay out).
CSV_COLUMNS = (
    "position", "title", "authors", "venue", "year", "cited_by_count", "link", "resource_link", "resource_type", "snippet", "cluster_id",
    "cited_by_url", "versions_count", "versions_url", "related_url", "citation_only", "query", "page_start", "fetched_at",
)

PROFILE = T.StructType(
    [T.StructField(n, _S) for n in ("user_id", "name", "affiliation", "organization", "homepage", "verified_email")]
    + [T.StructField("interests", T.ArrayType(_S))]
    + [T.StructField(n, _L) for n in ("cited_by_total", "cited_by_recent", "h_index", "h_index_recent", "i10_index", "i10_index_recent")]
    + [T.StructField("fetched_at", _S)]
)
EVENT = T.StructType(
    [
        T.StructField("at", _S), T.StructField("kind", _S), T.StructField("url", _S), T.StructField("reason", _S), T.StructField("request_index", _L),
        T.StructField("consecutive", _L), T.StructField("waited", _D), T.StructField("outcome", _S), T.StructField("target", _S), T.StructField("saw", T.ArrayType(_S)),
    ]
)
CURSOR = T.StructType([T.StructField("signature", _S), T.StructField("next_start", _L), T.StructField("exhausted", _B), T.StructField("updated_at", _S)])
