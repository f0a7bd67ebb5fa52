"""Several values packed in one field: split to one value per row, position kept.

``split_packed`` works on the Arrow string buffer itself: quote parity and
delimiter masks are numpy passes over the bytes of a whole batch, the child
offsets of an Arrow list array are derived from them, and the list is flattened
with its parent ordinals.  Nothing is split row by row, and the operator needs
no shuffle.

Rules (all defined results):

* null, empty or blank text, or text with no letter in it: no row.
* Delimiters are ``; | / & tab newline ； 、 · •`` and a free-standing ``and``;
  ``,`` and ``，`` delimit too, unless they stand between a surname and the
  given name of the same person ("Doe, J."), which stays one value.
* Delimiters inside double quotes, or inside the single quotes of a bracketed
  list, do not split; enclosing quotes and brackets are dropped.
* Empty places are skipped and not numbered; marks of omission (``…`` and
  ``...``) are no value and no part of one.
* Repeated values come out once per place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HARD = np.zeros(256, bool)
_HARD[list(b";|/&\t\n\r\v\f")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_LETTER = _UPPER | _LOWER
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\v\f")] = True
#: Three-byte delimiters, and whether they may join surname and given name.
_WIDE = ((b"\xef\xbc\x9b", False), (b"\xe3\x80\x81", False), (b"\xe2\x80\xa2", False), (b"\xef\xbc\x8c", True))


def _shift(a: np.ndarray, k: int, fill=0) -> np.ndarray:
    """``a`` seen k places later (k < 0: earlier), filled at the edge."""
    out = np.full_like(a, fill)
    if k > 0:
        out[:-k] = a[k:]
    elif k < 0:
        out[-k:] = a[:k]
    else:
        out[:] = a
    return out


def _count(mask: np.ndarray) -> np.ndarray:
    """Exclusive prefix counts, one longer than the mask."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def split_strings(column: pa.Array) -> pa.ListArray:
    """The values packed in each text of a string array, as a list array."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    size = len(raw)
    if column.null_count and n:  # a null may still own bytes of the buffer
        dead = np.repeat(~np.asarray(column.is_valid()), np.diff(offsets))
        raw = np.where(dead, 32, raw).astype(np.uint8)
    if not size:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    starts, lengths = offsets[:-1], np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    first = np.zeros(size, bool)
    first[starts[lengths > 0]] = True
    last = np.zeros(size, bool)
    last[offsets[1:][lengths > 0] - 1] = True
    prev = np.where(first, 0, _shift(raw, -1))
    nxt = np.where(last, 0, _shift(raw, 1))

    def begins(token: bytes) -> np.ndarray:
        m = np.ones(size, bool)
        for k, b in enumerate(token):
            m &= _shift(raw, k) == b
            if k:
                m &= _shift(row, k, -1) == row
        return m

    def spread(m: np.ndarray, k: int) -> np.ndarray:
        out = m.copy()
        for i in range(1, k):
            out |= _shift(m, -i)
        return out

    wide_space = spread(begins(b"\xc2\xa0"), 2) | spread(begins(b"\xe2\x80\x89"), 3) | spread(begins(b"\xe3\x80\x80"), 3)
    space = _SPACE[raw] | wide_space
    mark = spread(begins(b"\xe2\x80\xa6"), 3)
    mark |= spread(begins(b"...") & ~((_shift(raw, 3) == 46) & (_shift(row, 3, -1) == row)), 3)

    # Quotes: parity of double quotes within the row, and of single quotes that
    # touch the structure of a list.
    head = np.zeros(n, np.uint8)
    solid = ~space
    nth = np.where(solid, np.arange(size), size)
    next_solid = np.minimum.accumulate(nth[::-1])[::-1]
    has = lengths > 0
    at = next_solid[starts[has]]
    ok = at < offsets[1:][has]
    head[np.flatnonzero(has)[ok]] = raw[at[ok]]
    listed = (head == 91) | (head == 39)
    in_list = listed[row]
    double = raw == 34
    single = (raw == 39) & in_list & (np.isin(prev, list(b"\0[,; ")) | np.isin(nxt, list(b"\0],;")))
    parity = lambda m: ((c := _count(m))[1:] - c[starts][row]) % 2 == 1
    in_double = parity(double)
    single &= ~in_double
    quoted = in_double | parity(single)
    bracket = in_list & ((raw == 91) | (raw == 93)) & ~quoted
    edge = space | mark | double | single | bracket

    # Delimiters outside quotes.
    hard = _HARD[raw] & ~quoted
    soft = (raw == 44) & ~quoted
    unit = soft.copy()
    for token, joins in _WIDE:
        m = begins(token) & ~quoted
        if joins:
            unit |= m
            soft |= spread(m, 3)
        else:
            hard |= spread(m, 3)
    hard |= spread(begins(b"\xc2\xb7") & ~quoted, 2)
    before, low = np.where(first, True, _shift(space, -1)), raw | 32
    word = (low == 97) & before & ~first & ~quoted & (_shift(low, 1) == 110) & (_shift(low, 2) == 100) & (_shift(row, 2, -1) == row)
    after = np.where(_shift(row, 3, -1) == row, _shift(space, 3, True), True)
    word &= after & ((_shift(raw, 1) > 96) == (raw > 96)) & ((_shift(raw, 2) > 96) == (raw > 96))
    hard |= spread(word, 3)
    cut = hard | soft | bracket

    # Pieces: runs without delimiter, trimmed of spaces, quotes and marks.
    begin = np.flatnonzero(~cut & (first | np.where(first, True, _shift(cut, -1))))
    end = np.flatnonzero(~cut & (last | np.where(last, True, _shift(cut, 1)))) + 1
    core = np.where(edge, size, np.arange(size))
    to_core = np.append(np.minimum.accumulate(core[::-1])[::-1], size)
    from_core = np.append(-1, np.maximum.accumulate(np.where(edge | (raw == 44), -1, np.arange(size))))  # a cut "Doe," ends before its comma
    a, b = to_core[begin], from_core[end] + 1
    letters = _count(_LETTER[raw] & ~mark & ~wide_space)
    keep = (a < end) & (b > a)
    keep[keep] &= letters[b[keep]] > letters[a[keep]]
    a, b = a[keep], b[keep]
    if not len(a):
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    owner = row[a]

    # Tokens of the pieces, to tell a comma inside a name from one between names.
    tok = np.flatnonzero(~space & ~cut & ~edge & (first | np.where(first, True, _shift(space | cut | edge, -1))))
    tend = np.flatnonzero(~space & ~cut & ~edge & (last | np.where(last, True, _shift(space | cut | edge, 1)))) + 1
    uppers, lowers = _count(_UPPER[raw]), _count(_LOWER[raw] & ~mark & ~wide_space)
    initial = (lowers[tend] == lowers[tok]) & (uppers[tend] - uppers[tok] <= 3) & (uppers[tend] > uppers[tok])
    toks, inits = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    toks[tok + 1] = 1
    inits[tok[initial] + 1] = 1
    toks, inits = np.cumsum(toks), np.cumsum(inits)
    n_tok, n_init = toks[b] - toks[a], inits[b] - inits[a]
    lead_init = inits[a + 1] > inits[a]
    given = (n_tok == n_init) | ((n_tok - n_init == 1) & ~lead_init)
    particle = _LOWER[raw[a]] & (raw[a] < 128)
    surname = (n_init == 0) & ((n_tok == 1) | particle)
    perhaps = (n_init == 0) & (n_tok == 2) & ~particle
    hards, units, quotes = _count(hard | bracket), _count(unit), _count(double | single)
    m = len(a)
    joint = np.zeros(m, bool)
    if m > 1:
        same = owner[1:] == owner[:-1]
        gap = same & (hards[a[1:]] == hards[b[:-1]]) & (units[a[1:]] - units[b[:-1]] == 1) & (quotes[a[1:]] == quotes[b[:-1]])
        sure = gap & surname[:-1] & given[1:]
        pieces, certain = np.bincount(owner, minlength=n), np.bincount(owner[:-1][sure], minlength=n)
        backed = (certain[owner[:-1]] > 0) | (pieces[owner[:-1]] == 2)
        joint[:-1] = sure | (gap & perhaps[:-1] & (n_tok == n_init)[1:] & backed)
        # In a run of joints every second one holds: surname, given, surname, given.
        at = np.arange(m)
        opens = joint & ~np.append(False, joint[:-1])
        since = at - np.maximum.accumulate(np.where(opens, at, -1))
        joint &= since % 2 == 0
    lead = ~np.append(False, joint[:-1])
    tail = np.flatnonzero(~joint)
    lo, hi, owner = a[lead], b[tail], owner[lead]

    sizes = hi - lo
    new = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(sizes, out=new[1:])
    text = raw[np.repeat(lo - new[:-1], sizes) + np.arange(new[-1])]
    values = pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(new), pa.py_buffer(np.ascontiguousarray(text))).cast(pa.string())
    bounds = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def split_packed(df: DataFrame, text: str, value: str = "value", pos: str = "pos", keep: list[str] | None = None) -> DataFrame:
    """One row per value packed in ``text``: the columns ``keep`` of the row
    (default: all but ``text``), ``pos`` from 1 in written order, ``value``.

    Columns of the input named like ``pos`` or ``value`` are not carried.
    """
    names = [c for c in (keep if keep is not None else df.columns) if c not in (text, value, pos)]
    src = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__packed"))
    fields = [src.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField(pos, T.LongType()), T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_strings(batch.column(len(names)))
            parent = pc.list_parent_indices(lists)
            begin = np.asarray(lists.offsets)[:-1]
            ordinal = np.arange(len(parent)) - begin[np.asarray(parent)] + 1
            kept = [batch.column(i).take(parent) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ordinal, pa.int64()), pc.list_flatten(lists)], names=[*names, pos, value])

    return src.mapInArrow(run, schema)


#: What separates the author part of a byline from the rest.
BYLINE_BREAK = r"[\s ]+[-–—][\s ]+"
BYLINE_PIPE = r"[\s ]+\|[\s ]+"


def blank(c: Column) -> Column:
    """Null, or nothing but white space (of any kind)."""
    return c.isNull() | ~c.rlike(r"[^\s  -​　]")


def byline_authors(byline: Column) -> Column:
    """The author part of "authors - venue, year - host".

    The parts are set off by a dash with white space on both sides, or by
    ``|`` when there is no such dash; then the last two parts (the last one, if
    there are but two) are venue and host.  Without any break the whole byline
    is the author part; null stays null.
    """
    dash = F.split(F.concat(F.lit(" "), byline, F.lit(" ")), BYLINE_BREAK, 2)
    pipe = F.split(byline, BYLINE_PIPE)
    n = F.size(pipe)
    return (
        F.when(F.size(dash) > 1, F.get(dash, F.lit(0)))
        .when(n > 1, F.array_join(F.slice(pipe, 1, F.greatest(n - 2, F.lit(1))), " | "))
        .otherwise(byline)
    )


def author_names(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default ``obs_id``), ``pos``, ``name``: one row per author written in a
    record, from ``authors`` or, where that is null or blank, from the byline."""
    keep = keep or ["obs_id"]
    source = F.when(blank(F.col("authors")), byline_authors(F.col("byline"))).otherwise(F.col("authors"))
    return split_packed(results.select(*keep, source.alias("__text")), "__text", value="name", keep=keep)
