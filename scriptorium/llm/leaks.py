"""Evaluation texts leaking into training text: a generalised suffix automaton over the test items.

The automaton is built over the words of the items and shipped to the tasks;
documents stream through it where they are read, without shuffle.  Item sets of
more than ``SHARD_WORDS`` words are cut into shards by a hash of the text, each
with an automaton of its own, and the documents stream through one after the
other.  At every word the longest match that ends there is tracked; a match that
cannot go on is a run.  A run of at most ``QUOTE`` words counts for an item if it
stands in no other item of any shard, so stock phrases and sentences built alike
say nothing; a longer one counts for every item that has it.  A run that goes on in
one item hides that it ended in another: items that share more than a quotation with
the one found are matched by themselves where that could make them leak.  The runs of an item
are chained in order, with small changes and one interruption of any length between
them, and the item leaks if the chain covers ``share`` of its words and one run is
longer than a quotation.

Defined results: null and empty texts have no leak; copies of a document leak
like it; of equal items each is reported; an item of ``QUOTE`` words or fewer is
never found, since all of it is no more than a quotation; texts of any length are
read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: A run has so many words at least, a quotation has so many at most.
MIN_RUN, QUOTE = 4, 8
#: Share of an item's words that makes a leak; words of the document a gap may have, but for one
#: interruption of any length.
SHARE, INTERRUPTION = 0.4, 120
#: Words of the items in one automaton, about (some 300 bytes each in every worker).
SHARD_WORDS = 200_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def gram_hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(words)) - (1 << 63)


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.

    For each state: the items its words stand in and where they end there; a state
    of short words in several items has none.  ``foreign``: hashes of short runs
    that stand in items held elsewhere.
    """

    def __init__(self, items: list[tuple[int, list[str]]], foreign: frozenset[int] = frozenset()):
        alike: dict[tuple[str, ...], list[int]] = {}
        for i, w in items:
            alike.setdefault(tuple(w), []).append(i)
        self.ids: dict[str, int] = {}
        self.items, self.texts = list(alike.values()), [list(w) for w in alike]
        self.lengths = [len(w) for w in alike]
        self.foreign = foreign
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for k, words in enumerate(alike):
            last = 0
            for p, w in enumerate(words):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)), ends)
                ends[last].append((k, p))
        self.ends = self._owners(ends)
        self.kin: dict[int, dict[int, int]] = {}  # item -> items that share more than a quotation with it, and how much at once
        for s, held in enumerate(self.ends):
            if self.shared[s] and self.len[s] > QUOTE:
                for k in (owners := {k for k, _ in held}):
                    for j in owners - {k}:
                        self.kin.setdefault(k, {})[j] = max(self.len[s], self.kin.get(k, {}).get(j, 0))
        self.alone: dict[int, SuffixAutomaton] = {}

    def _extend(self, last: int, c: int, ends: list) -> int:
        if c in self.next[last]:  # another item has been here
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c, ends)
        cur = self._state(self.len[last] + 1, {}, ends)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c, ends)
        return cur

    def _state(self, length: int, edges: dict[int, int], ends: list) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(0)
        ends.append([])
        return len(self.len) - 1

    def _clone(self, p: int, q: int, c: int, ends: list) -> int:
        twin = self._state(self.len[p] + 1, dict(self.next[q]), ends)
        self.link[twin] = self.link[q]
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _owners(self, ends: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """Places handed up the suffix links."""
        several = [False] * len(ends)
        for s in sorted(range(1, len(ends)), key=lambda s: -self.len[s]):
            several[s] = several[s] or len({k for k, _ in ends[s]}) > 1
            if several[s] and self.len[s] <= QUOTE:
                ends[s] = []
            up = self.link[s]
            if up > 0:
                several[up] = several[up] or several[s] or bool(ends[up] and ends[s] and ends[up][0][0] != ends[s][0][0])
                if not (several[up] and self.len[up] <= QUOTE):
                    ends[up].extend(ends[s])
        self.shared = several
        return ends

    def counts(self, words: list[str]) -> bool:
        """Whether a short run says anything: its words stand in one item only."""
        state = 0
        for w in words:
            state = self.next[state].get(self.ids.get(w, -1), 0)
        return not self.shared[state] and not (self.foreign and gram_hash(words) in self.foreign)

    def all_runs(self, words: list[str], share: float) -> dict[int, list[tuple[int, int, int]]]:
        """:meth:`runs`, and those of items hidden by others that could cover ``share`` of their words."""
        found = self.runs(words)
        hidden: dict[int, int] = {}
        for k, runs in found.items():
            for j, most in self.kin.get(k, {}).items():
                hidden[j] = hidden.get(j, 0) + sum(min(n, most) for *_, n in runs if n > QUOTE)
        for j, more in hidden.items():
            if more + sum(n for *_, n in found.get(j, ())) >= share * self.lengths[j]:
                if j not in self.alone:
                    self.alone[j] = SuffixAutomaton([(j, self.texts[j])])
                own = self.alone[j].runs(words).get(0, [])
                found[j] = [(q, p, n) for q, p, n in own if n > QUOTE or self.counts(words[q : q + n])]
        return found

    def runs(self, words: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """Per item: (first word in the document, first word in the item, words) of the runs that count for it."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        nxt, link, length, ids = self.next, self.link, self.len, self.ids
        state, size, open_run = 0, 0, False

        def close(q: int) -> None:
            if size <= QUOTE and (self.shared[state] or (self.foreign and gram_hash(words[q - size : q]) in self.foreign)):
                return
            for k, p in self.ends[state]:
                found.setdefault(k, []).append((q - size, p - size + 1, size))

        q = -1
        for q, w in enumerate(words):
            c = ids.get(w)
            if c is None:
                if size >= MIN_RUN and open_run:
                    close(q)
                state, size = 0, 0
                continue
            go = nxt[state].get(c)
            if go is None:
                if size >= MIN_RUN and open_run:
                    close(q)
                open_run = False
                while state and go is None:
                    state = link[state]
                    go = nxt[state].get(c)
                size = length[state]
                if go is None:
                    continue
            state = go
            size += 1
            open_run = True
        if size >= MIN_RUN and open_run:
            close(q + 1)
        return found


def chain(runs: list[tuple[int, int, int]], interruption: int = INTERRUPTION) -> tuple[int, int, list[tuple[int, int]]]:
    """Item words covered by the best chain of runs in order, its longest run, and the document words of its runs.

    One gap of the chain may have any length, the others ``interruption`` words.  Runs that near are looked at one by one; of
    those farther back only the best chain that ends at each place of the item matters.
    """
    runs = sorted(set(runs))
    by_end = sorted(range(len(runs)), key=lambda i: runs[i][0] + runs[i][2])
    longest = max(n for *_, n in runs)
    # A chain: words covered, longest run, its last run, the chain before it.
    near: list[tuple] = []  # all gaps short
    any_: list[tuple] = []  # at most one long
    far: dict[tuple[int, int], tuple] = {}
    out = 0

    def better(top: tuple | None, before: tuple, j: int) -> tuple | None:
        q, p, n = runs[j]
        q2, p2, n2 = runs[before[2]]
        lap = max(0, p2 + n2 - p, q2 + n2 - q)
        if p2 < p and q2 < q and lap < n:
            new = (before[0] + n - lap, max(before[1], n), j, before)
            return new if top is None or new[:2] > top[:2] else top
        return top

    for j, (q, _, n) in enumerate(runs):
        while out < len(by_end) and (i := by_end[out]) < j and runs[i][0] + runs[i][2] < q - interruption:
            spot = runs[i][1:]
            if spot not in far or near[i][:2] > far[spot][:2]:
                far[spot] = near[i]
            out += 1
        top = wide = (n, n, j, None)
        i = j - 1
        while i >= 0 and runs[i][0] >= q - interruption - longest:
            if q - (runs[i][0] + runs[i][2]) <= interruption:
                top = better(top, near[i], j)
                wide = better(wide, any_[i], j)
            i -= 1
        for before in far.values():
            wide = better(wide, before, j)
        near.append(top)
        any_.append(max(top, wide, key=lambda c: c[:2]))
    best = at = max(any_, key=lambda c: c[:2])
    spans = []
    while at is not None:
        q, _, n = runs[at[2]]
        spans.append((q, q + n))
        at = at[3]
    return best[0], best[1], spans[::-1]


def automata(items: DataFrame, item_id: str = "item_id", text: str = "text", shard_words: int = SHARD_WORDS) -> Iterator[SuffixAutomaton]:
    """One automaton per shard of the items; one shard at a time is on the driver."""
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).rlike(r"\S")).select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.size(F.split("t", r"\W+")))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("t"), F.lit(shards)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(t)
                got = {gram_hash(w[k : k + n]) for n in range(MIN_RUN, QUOTE + 1) for k in range(len(w) - n + 1)}
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(got), pa.int64()), pa.array(list(got), pa.int64())], names=["shard", "gram"])

    held = rows.select("shard", "t").mapInArrow(grams, "shard long, gram long").distinct() if shards > 1 else None
    for k in range(shards):
        foreign: frozenset[int] = frozenset()
        if held is not None:  # at most a few grams a word of the shard
            others = held.where(F.col("shard") != k).select("gram")
            foreign = frozenset(r[0] for r in held.where(F.col("shard") == k).select("gram").join(others, "gram", "left_semi").collect())
        yield SuffixAutomaton([(r[0], words_of(r[1])) for r in sorted(rows.where(F.col("shard") == k).select("item", "t").collect())], foreign)


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``share`` of the item's words, ``longest`` run, and the ``spans`` of words of the document that hold them."""
    src = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, share double, longest int, spans array<struct<first: int, last: int>>"

    def through(automaton: SuffixAutomaton) -> DataFrame:
        shipped = documents.sparkSession.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = shipped.value
            for batch in batches:
                out: list[tuple] = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, rs in a.all_runs(words_of(t), share).items():
                        if not rs or sum(n for *_, n in rs) < share * a.lengths[k]:
                            continue
                        covered, longest, spans = chain(rs)
                        if covered >= share * a.lengths[k] and longest > QUOTE:
                            out += [(d, i, min(1.0, covered / a.lengths[k]), longest, [{"first": x, "last": y} for x, y in spans]) for i in a.items[k]]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "share", "longest", "spans"])

        return src.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(through, automata(items, shard_words=shard_words)))


def without_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``doc_id``, ``text`` without the words that an item and the document share, ``n_removed`` words, for the
    documents that leak; what stands between two runs of an item stays."""
    found = leaks(documents, items, doc_id, text, share).groupBy("doc_id").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    src = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(found, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = {w for s in spans for w in range(s["first"], s["last"])}
                at = [m.span() for m in WORD.finditer(t.lower() if len(t) == len(t.lower()) else t)]
                keep, pos = [], 0
                for w in sorted(gone):
                    if w < len(at):
                        if w - 1 not in gone:
                            keep.append(t[pos : at[w][0]])
                        pos = at[w][1]
                keep.append(t[pos:])
                texts.append("".join(keep))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_removed"])

    return src.mapInArrow(run, "doc_id long, text string, n_removed long")
