"""Text cut off by field limits: find cut values and report how often each source cuts.

For every source and column two length histograms are kept, in characters and in
bytes, over the distinct values that carry no mark of omission and no terminal
punctuation.  A length with far more values than the lengths around it is a
spike: the field limit of that source.  Values of a spike's length without
terminal punctuation are cut, unless the same value stands whole in other
sources.

A field limit is not the only way a text is lost: a value may say so (a mark of
omission at its beginning or end), or break off in the middle of a transfer at
any length (half a character, an entity, a tag, an open list; running text that
ends inside a sentence).  No histogram shows these; ``way`` tells which of the
four ways a value was found by, and the report counts them apart.

The text itself is looked at once; what is kept of it is a row of flags and
lengths.  The histograms are aggregated before they are windowed, so a source
with a third of all rows adds one row per length.  The spikes are broadcast if
there are at most ``SHIPPED_ROWS``, else joined.

Defined results: null and blank values, and an empty table, give no row; a value
repeated in many rows is judged in each of them; a missing source is a source of
its own; very long texts are judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Marks of omission at either end.
END_MARK = r"(…|\.\.\.)[\s\x{A0}]*$"
BEGIN_MARK = r"^[\s\x{A0}]*(…|\.\.\.)"
#: A transfer that broke off: half a character, entity or tag, a tag opened and not closed.
BROKEN_END = r"(\x{FFFD}|&#?\w{0,7}|<[^<>]{0,20}|\s<\w{1,6}>[^<]{0,12})$"
BROKEN_BEGIN = r"^(\x{FFFD}|[^<]{0,12}</\w{1,6}>)"
#: Ends of whole running text: closing punctuation, perhaps a bracket or quote behind it, or an address; a space behind it shows that more followed.
SENTENCE_END = r"""([.?!。！？][)\]"'”’»]*|\([^()]*\)|https?://\S+/\S+)$"""
#: A list that was opened and not closed; a closed one is whole.
OPEN_LIST = r"^\s*\[.*[^\]\s]\s*$"
CLOSED_LIST = r"""(\]|^\s*".*")\s*$"""


@dataclass(frozen=True)
class Field:
    """A text column; ``sentences``: whole values end in terminal punctuation."""

    name: str
    sentences: bool = False
    lists: bool = False


FIELDS = (Field("authors", lists=True), Field("venue"), Field("snippet", sentences=True))
#: A spike has this many times the values of the lengths around it, and at least so many;
#: where another source has the same limit, fewer will do.
#: and at most ABOVE times its values are longer still.
RATIO, LEAST, LEAST_SHARED, AROUND, ABOVE = 4.0, 8, 3, 5, 4
#: Spikes (a few numbers each) and attested values (of :func:`_attested`) that are broadcast, at most.
SHIPPED_ROWS = 100_000


def host(url: Column) -> Column:
    """Host of a URL, or null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\w+://([^/?#\s]+)", 1)), F.lit(""))


def result_source() -> Column:
    """Where a record came from: the host of its link, else the host its byline ends in."""
    return F.coalesce(host(F.col("link")), F.nullif(F.lower(F.regexp_extract("byline", r"(?:^|[\s\x{A0}])([\w-]+(?:\.[\w-]+)+)\s*$", 1)), F.lit("")))


def _cells(df: DataFrame, row_id: str, source: Column, fields: tuple[Field, ...], values: bool) -> DataFrame:
    """One row per value: what it says of itself, and whether its end may be that of a whole value.

    The value is kept with ``values``, and for names, whose words are looked at again.
    """

    def cell(f: Field) -> Column:
        v = F.col(f"`{f.name}`")
        begun, ended = v.rlike(BEGIN_MARK), v.rlike(END_MARK)
        torn = v.rlike(BROKEN_END) | (v.rlike(OPEN_LIST) if f.lists else F.lit(False))
        whole = v.rlike(SENTENCE_END) if f.sentences else v.rlike(CLOSED_LIST) if f.lists else F.lit(False)
        kept = v if values or not (f.sentences or f.lists) else F.lit(None).cast("string")
        return F.struct(
            F.lit(f.name).alias("field"), kept.alias("value"), F.xxhash64(v).alias("h"), F.length(v).alias("chars"), F.octet_length(v).alias("bytes"), v.rlike(r"[^\s\x{A0}]").alias("some"), begun.alias("begun"),
            v.rlike(BROKEN_BEGIN).alias("torn_begin"), ended.alias("marked"), torn.alias("torn"), (ended | torn).alias("ended"), whole.alias("whole"), (~whole if f.sentences else F.lit(False)).alias("unended"),
        )

    rows = df.select(F.col(f"`{row_id}`").alias("__id"), F.coalesce(source, F.lit("")).alias("source"), F.inline(F.array(*[cell(f) for f in fields])))
    return rows.where("some").drop("some")


def _broken_words(distinct: DataFrame) -> DataFrame:
    """The distinct values whose last word is never seen before another word: likely cut inside it.

    Names are repeated so much that their natural lengths have peaks of their own;
    a field limit shows in the values that break off inside a word.
    """
    words = F.split(F.lower("value"), r"[^\p{L}]+")
    inner = distinct.select("field", F.explode(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).alias("word")).distinct()
    last = distinct.withColumn("word", F.lower(F.regexp_extract("value", r"(\p{L}+)$", 1))).where("word <> ''")
    return last.join(inner, ["field", "word"], "left_anti").drop("word")


def length_spikes(cells: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """``source``, ``field``, ``at_chars``, ``at_bytes``: the lengths at which the source cuts."""
    named = [f.name for f in fields if not f.sentences and not f.lists]
    open_ended = cells.where(~F.col("ended") & ~F.col("whole"))
    distinct = open_ended.groupBy("source", "field", "chars", "bytes", F.when(F.col("field").isin(named), F.col("value")).alias("value"), "h").agg(F.lit(1).alias("n"))
    texts = distinct.where(~F.col("field").isin(named))
    if named:
        texts = texts.unionByName(_broken_words(distinct.where(F.col("field").isin(named))))
    unit = F.inline(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len"))))
    hist = texts.select("source", "field", unit).groupBy("source", "field", "unit", "len").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source", "field", "unit").orderBy("len")
    hist = hist.withColumn("others", (F.sum("n").over(order.rangeBetween(-AROUND, AROUND)) - F.col("n")) / (2.0 * AROUND))
    hist = hist.withColumn("above", F.coalesce(F.sum("n").over(order.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)))
    at_end = F.col("field").isin(named) | (F.col("n") * ABOVE >= F.col("above"))
    peak = hist.where((F.col("n") >= LEAST_SHARED) & (F.col("n") > RATIO * F.greatest(F.col("others"), F.lit(0.5))) & at_end)
    shared = Window.partitionBy("field", "unit", "len")
    peak = peak.withColumn("sure", F.max(F.col("n") >= LEAST).over(shared)).where("sure")
    lens = lambda u: F.collect_set(F.when(F.col("unit") == u, F.col("len")))  # noqa: E731  at most one row per length
    return peak.groupBy("source", "field").agg(lens("chars").alias("at_chars"), lens("bytes").alias("at_bytes"))


def _shipped(small: DataFrame) -> DataFrame:
    """``small`` stored, and broadcast if it has at most :data:`SHIPPED_ROWS` rows."""
    small = materialize(small)
    return F.broadcast(small) if small.count() <= SHIPPED_ROWS else small


def _attested(doubt: DataFrame) -> DataFrame:
    """``field``, ``value``: as long as a limit, but two sources without that limit have it too, half as often at least."""
    per = doubt.groupBy("field", "value", "source").agg(F.count_if("at_spike").alias("spiked"), F.count_if(~F.col("at_spike")).alias("free"))
    seen = per.groupBy("field", "value").agg(F.sum("spiked").alias("spiked"), F.sum("free").alias("free"), F.count_if(F.col("free") > 0).alias("sources"))
    return seen.where("spiked > 0 and sources >= 2 and free * 2 >= spiked").select("field", "value", F.lit(True).alias("attested"))


def cut_values(df: DataFrame, row_id: str = "obs_id", source: Column | None = None, fields: tuple[Field, ...] = FIELDS, values: bool = True) -> DataFrame:
    """``row_id``, ``source``, ``field``, ``value`` (with ``values``), ``chars``, ``cut_begin``, ``cut_end``, ``way``: one
    row per value of ``fields`` that is neither null nor blank; it was cut where one of the flags holds.  ``way``:
    'mark' (it says so), 'limit' (at a spike, without terminal punctuation), 'torn' or 'unended' (broke off), null if whole."""
    cells = materialize(_cells(df, row_id, result_source() if source is None else source, fields, values))  # read three times
    joined = cells.join(_shipped(length_spikes(cells, fields)), ["source", "field"], "left")
    at = F.array_contains("at_chars", F.col("chars")) | F.array_contains("at_bytes", F.col("bytes"))
    joined = joined.withColumn("at_spike", F.coalesce(at, F.lit(False)) & ~F.col("ended") & ~F.col("whole"))
    # A value of no running text may be as long as the limit and whole: then other sources have it too.
    named = [f.name for f in fields if not f.sentences and not f.lists]
    if named:
        doubt = joined.where(F.col("field").isin(named) & ~F.col("ended")).select("field", "value", "source", "at_spike")
        joined = joined.join(_shipped(_attested(doubt)), ["field", "value"], "left")
        joined = joined.withColumn("at_spike", F.col("at_spike") & F.col("attested").isNull()).drop("attested")
    way = F.when(F.col("begun") | F.col("marked"), "mark").when(F.col("at_spike"), "limit").when(F.col("torn_begin") | F.col("torn"), "torn").when(F.col("unended"), "unended")
    kept = ["value"] if values else []
    return joined.select(
        F.col("__id").alias(row_id), "source", "field", *kept, "chars", (F.col("begun") | F.col("torn_begin")).alias("cut_begin"), (F.col("ended") | F.col("unended") | F.col("at_spike")).alias("cut_end"), way.alias("way")
    )


def truncation_report(df: DataFrame, row_id: str = "obs_id", source: Column | None = None, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """``source``, ``field``, ``n_values``, ``n_cut``, ``share``, how many were found by each way (``n_mark``, ``n_limit``,
    ``n_torn``, ``n_unended``) and the ``limits`` found, for each source and column."""
    v = cut_values(df, row_id, source, fields, values=False)
    ways = [F.count_if(F.col("way") == w).alias(f"n_{w}") for w in ("mark", "limit", "torn", "unended")]
    return v.groupBy("source", "field").agg(
        F.count(F.lit(1)).alias("n_values"), F.count("way").alias("n_cut"), (F.count("way") / F.count(F.lit(1))).alias("share"), *ways, F.sort_array(F.collect_set(F.when(F.col("way") == "limit", F.col("chars")))).alias("limits")
    )
