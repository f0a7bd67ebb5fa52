"""Free-typed values mapped to a reference list: a trie searched with a Levenshtein automaton.

Two tries are held.  The trie of words has the letters of all words of the
list; a Levenshtein automaton is run over it, so that every listed word within a
distance that depends on the word's length is found, and at every inner node an
alias path leads on to the words it abbreviates ("Int" - "International").  The
trie of entries has the words of every name, with alias paths for its acronym
and, for values that lost their beginning, for its endings; the words found for
each word of a value are its edges.  All entries within a distance that depends
on the length of the value are returned, best first; a word that stands in the list
stands for itself or for a longer one, never for a near one.

The list is shipped to the tasks in shards of ``SHARD_ENTRIES`` entries; what the
search must know of the whole list (its words and publishers) goes with each
shard.  With one shard values are matched where they are read, each distinct value
once per task, without shuffle, so no value, however common, is a hot key; with
more the distinct values pass through one shard after the other and the best entry
of all shards is joined back.

Defined results: null and blank values, and an empty table, give no row; a value
that means no entry comes out with id 0; of equally near entries the first in
the list's order of ids is taken; repeated rows come out once each.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that decomposition leaves alone, words that carry no meaning, short forms that are no prefix.
LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
STOP = frozenset("of on the and in for a an und et de der die das".split())
SHORT = {"wksp": "workshop", "wkshp": "workshop", "jnl": "journal", "jl": "journal", "intl": "international", "intnl": "international", "natl": "national", "dept": "department", "ltrs": "letters", "qtly": "quarterly"}
NUMBERS = re.compile(r"(?:^|(?<![^\W\d_]))[\s,;:.]*(?:(?:\b(?:vol|no|pp?|nr|issue|volume|number)\b\.?\s*)?['’]?\d+(?!\w)|\(\d*\)?|[-–—]|\b(?:vol|no|pp)\.)[\s,;:.)]*$", re.IGNORECASE)
LEADING = re.compile(r"^\s*(?:['’]?\d+(?:st|nd|rd|th)?\b\.?|annual\b|the\b|proceedings of (?=the \d))\s*", re.IGNORECASE)
MARK_END, MARK_BEGIN = re.compile(r"\s*(?:…|\.\.\.|�)\s*$"), re.compile(r"^\s*(?:…|\.\.\.|�)\s*")
ACRONYM = re.compile(r"\s*\(([A-Z][A-Za-z]{2,})\)?")
#: Words without meaning that may as well be short forms ("For." for Forecasting).
TELLING = frozenset({"for", "in"})
#: Entries of the list in one trie; values and words remembered per task.
SHARD_ENTRIES, MAX_MEMO = 10_000, 200_000
#: How an entry was found, best first: by its acronym, by all its words, by a part of it; LOOSE more with words that may be stop words.
BY_ACRONYM, BY_WORDS, BY_PART, LOOSE = 0, 1, 2, 2


def plain(text: str) -> str:
    """Without accents, entities and odd spaces."""
    text = html.unescape(text).translate(LETTERS)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def fold_word(word: str) -> str:
    """Letters only, digits inside a word read as the letters they stand for."""
    if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
        word = word.translate(str.maketrans("015", "ols"))
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def words_of(text: str, stop: frozenset[str] = STOP) -> list[str]:
    found = (fold_word(w) for w in re.split(r"[^\w'’]+", text.lower()))
    return [w for w in found if w and w not in stop]


def strip_numbers(part: str) -> str:
    while True:
        less = NUMBERS.sub("", part)
        if less == part:
            return part
        part = less


class Parsed:
    """A typed value: words of its name, whether an end is missing, and acronyms in brackets."""

    __slots__ = ("acronyms", "begin_cut", "dangling", "end_cut", "loose", "parts", "words")

    def __init__(self, value: str):
        text = plain(value)
        self.begin_cut, self.end_cut = bool(MARK_BEGIN.search(text)), bool(MARK_END.search(text))
        text = MARK_END.sub("", MARK_BEGIN.sub("", text)).strip().strip("\"'“”‘’«»").strip()
        self.acronyms = [a.lower() for a in ACRONYM.findall(text)]
        text = ACRONYM.sub(" ", text)
        parts = []
        for k, part in enumerate(text.split(",")):
            part = strip_numbers(part.strip().rstrip(".;:"))
            if not k:
                while (less := LEADING.sub("", part)) != part:
                    part = less
            if re.search(r"[^\W\d_]", part):
                parts.append(part.strip())
        self.parts = [words_of(p) for p in parts]
        last = re.findall(r"\w+", parts[-1].lower())[-1:] if parts else []
        self.dangling = bool(last) and last[0] in STOP
        self.words = [w for p in self.parts for w in p]
        self.loose = [words_of(p, STOP - TELLING) for p in parts]


class WordTrie:
    """Trie of words; search by a Levenshtein automaton whose states are rows of distances."""

    def __init__(self, words: set[str]):
        self.words = words
        self.root: dict = {}
        for w in sorted(words):
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.memo: dict[str, list[tuple[str, float]]] = {}

    @staticmethod
    def reach(word: str) -> int:
        return 0 if len(word) < 4 else 1 if len(word) < 9 else 2

    def within(self, word: str, most: int) -> list[tuple[str, int]]:
        """All words within ``most`` edits (swapped neighbours are one edit)."""
        out, n = [], len(word)

        def step(node: dict, state: dict, older: dict, prev: str) -> None:
            """``state``: position in ``word`` -> edits so far (only those within reach)."""
            for ch, child in node.items():
                if not ch:
                    if state.get(n, most + 1) <= most:
                        out.append((child, state[n]))
                    continue
                after: dict[int, int] = {}
                for j, d in state.items():
                    if j < n and word[j] == ch:
                        after[j + 1] = min(d, after.get(j + 1, 9))
                    elif d < most:
                        after[j + 1] = min(d + 1, after.get(j + 1, 9))
                    if d < most:
                        after[j] = min(d + 1, after.get(j, 9))
                for j, d in older.items():
                    if d < most and j + 1 < n and word[j] == ch and word[j + 1] == prev:
                        after[j + 2] = min(d + 1, after.get(j + 2, 9))
                for j in sorted(after):  # letters of the typed word that the listed one lacks
                    if after[j] < most and j < n:
                        after[j + 1] = min(after[j] + 1, after.get(j + 1, 9))
                after = {j: d for j, d in after.items() if j <= n}
                if after:
                    step(child, after, state, ch)

        step(self.root, {j: j for j in range(min(most, n) + 1)}, {}, "")
        return out

    def extensions(self, stem: str) -> list[str]:
        """The words an alias path leads to from the node of ``stem``."""
        node = self.root
        for c in stem:
            node = node.get(c)
            if node is None:
                return []
        out, todo = [], [node]
        while todo:
            n = todo.pop()
            for c, child in n.items():
                if c:
                    todo.append(child)
                else:
                    out.append(child)
        return out

    def find(self, word: str) -> list[tuple[str, float]]:
        """Listed words that ``word`` may stand for, with their cost."""
        got = self.memo.get(word)
        if got is None:
            if word in self.words:
                got = [(word, 0.0)] + [(w, 0.3) for w in self.extensions(word) if w != word]
            else:
                costs = {w: float(d) for w, d in self.within(word, self.reach(word))}
                for w in (word.replace("rn", "m"), word.replace("m", "rn"), *(word[:k] + "rn" + word[k + 1 :] for k, c in enumerate(word) if c == "m")):
                    if w in self.words:
                        costs[w] = 1.0
                for w in [meant] if (meant := fold_word(SHORT.get(word, ""))) in self.words else self.extensions(word):
                    costs[w] = 0.2
                got = sorted(costs.items(), key=lambda x: x[1])
            if len(self.memo) > MAX_MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got


Entry = tuple[int, str, str | None, str | None]


class VenueList:
    """What the search knows of the whole list: its words, its names, what one name has more than another, the publishers."""

    def __init__(self, entries: list[Entry]):
        names = {tuple(words_of(plain(n))) for _, n, _, _ in entries if n}
        self.words = {w for ws in names for w in ws}
        self.rests = {ws[k:] for ws in names for k in range(1, len(ws)) if ws[:k] in names}
        self.publishers = {tuple(words_of(plain(p))) for *_, p in entries if p}


class VenueTrie:
    """Tries over ``entries`` (id, name, acronym, publisher), a shard of the list or all of it."""

    def __init__(self, entries: list[Entry], whole: VenueList | None = None):
        whole = whole or VenueList(entries)
        self.root: dict = {}
        self.tails: dict = {}
        self.acronyms: dict[str, list[int]] = {}
        self.rests, self.publishers = whole.rests, whole.publishers
        self.words = WordTrie(whole.words)
        for i, n, a, _ in sorted(entries, key=lambda e: e[0]):
            ws = tuple(words_of(plain(n))) if n else ()
            self._add(self.root, ws, i)
            if ws[:1] == ("proceedings",) and len(ws) > 2:
                self._add(self.root, ws[1:], i)
            for k in range(1, len(ws)):
                self._add(self.tails, ws[k:], i)
            if a:
                self.acronyms.setdefault(a.lower(), []).append(i)
        self.house = WordTrie({w for p in self.publishers for w in p})
        self.folded: dict[str, list[int]] = {}
        for a, ids in self.acronyms.items():
            self.folded.setdefault(fold_word(a), []).extend(ids)
        self.memo: dict[str, list[tuple[int, float, int]]] = {}
        self.found: dict[tuple, list[tuple[int, float, int]]] = {}
        self.known: dict[tuple[str, ...], bool] = {}

    @staticmethod
    def _add(node: dict, words: tuple[str, ...], entry: int) -> None:
        """Entries with the same words end at one node."""
        if words:
            for w in words:
                node = node.setdefault(w, {})
            node.setdefault("", []).append(entry)

    def is_publisher(self, words: list[str]) -> bool:
        key = tuple(words)
        if key not in self.known:
            if len(self.known) > MAX_MEMO:
                self.known.clear()
            self.known[key] = key in self.publishers or self._near_publisher(words)
        return self.known[key]

    def _near_publisher(self, words: list[str]) -> bool:
        found = [[w for w, c in self.house.find(x) if c <= 1] for x in words]
        return bool(found) and all(found) and any(len(p) == len(words) and all(w in f for w, f in zip(p, found, strict=True)) for p in self.publishers)

    def names(self, parsed: Parsed, loose: bool = False) -> list[str]:
        """The words of the value without publishers."""
        parts = parsed.loose if loose else parsed.parts
        left = [p for p in parts if not self.is_publisher(p)] if len(parts) > 1 else parts
        words = [w for p in left or parts for w in p]
        if "preprint" in words and len(words) > 1:  # a server's name, once or twice, beside what it is
            words = list(dict.fromkeys(w for w in words if w != "preprint"))
        return words or parsed.words

    def search(self, root: dict, words: list[str], most: float) -> tuple[list[tuple[float, int]], list[tuple[float, dict]]]:
        """Entries spelled by all ``words`` within ``most``, and the inner nodes at which words ended."""
        full, inner, n = [], [], len(words)
        lists = [self.words.find(w) for w in words]
        strange = [w not in self.words.words for w in words]
        joined = [self.words.find(words[k] + words[k + 1]) if k + 1 < n and (strange[k] or strange[k + 1]) else [] for k in range(n)]
        todo = [(0.0, 0, root)]
        while todo:
            cost, k, node = todo.pop()
            if k == n:
                full += [(cost, e) for e in node.get("", ())]
                inner.append((cost, node))
                continue
            for w, c in lists[k]:
                child = node.get(w)
                if child is not None and cost + c <= most:
                    todo.append((cost + c, k + 1, child))
            if cost + 1 <= most:
                for w, c in joined[k]:  # a space typed inside a word
                    child = node.get(w)
                    if child is not None and c in (0.0, 1.0) and cost + 1 + c <= most and len(words[k]) + len(words[k + 1]) > 5:
                        todo.append((cost + 1 + c, k + 2, child))
                if len(words[k]) <= 3 and strange[k]:  # a mistyped word without meaning
                    todo.append((cost + 1, k + 1, node))
                for w, child in node.items() if strange[k] else ():  # a space left out
                    if w and words[k].startswith(w) and len(words[k]) > len(w) + 2:
                        rest = words[k][len(w) :]
                        for s in (rest, *(rest[len(x) :] for x in STOP if rest.startswith(x))):
                            if s in child:
                                todo.append((cost + 1, k + 1, child[s]))
        return full, inner

    @staticmethod
    def below(node: dict) -> list[tuple[int, tuple[str, ...]]]:
        out, todo = [], [(node, ())]
        while todo:
            n, path = todo.pop()
            for w, child in n.items():
                if w:
                    todo.append((child, (*path, w)))
                else:
                    out += [(e, path) for e in child]
        return out

    def matches(self, value: str) -> list[tuple[int, float, int]]:
        """(way, distance, id) of all entries within the distance the length of the value allows, best first."""
        got = self.memo.get(value)
        if got is None:
            if len(self.memo) > MAX_MEMO:
                self.memo.clear()
            got = self.memo[value] = self._of(Parsed(value))
        return got

    def _of(self, parsed: Parsed) -> list[tuple[int, float, int]]:
        words = self.names(parsed)
        if not words:
            return sorted((BY_ACRONYM, 0.0, i) for a in parsed.acronyms for i in self.acronyms.get(a, ()))
        got = self._known(words, parsed)
        if not got and (loose := self.names(parsed, True)) != words:
            got = [(way + LOOSE, c, i) for way, c, i in self._known(loose, parsed)]
        return got

    def _known(self, words: list[str], parsed: Parsed) -> list[tuple[int, float, int]]:
        key = (*words, parsed.begin_cut, parsed.end_cut or parsed.dangling)
        got = self.found.get(key)
        if got is None:
            if len(self.found) > MAX_MEMO:
                self.found.clear()
            got = self.found[key] = self._matches(words, parsed.begin_cut, parsed.end_cut or parsed.dangling)
        return got

    def _matches(self, words: list[str], begin_cut: bool, told: bool) -> list[tuple[int, float, int]]:
        if len(words) == 1 and words[0] in self.folded:
            return sorted((BY_ACRONYM, 0.0, i) for i in self.folded[words[0]])
        most = min(3.0, 1.0 + sum(map(len, words)) // 16) + 0.3 * len(words)
        if begin_cut and words[0] not in self.words.words:  # the first word lost its beginning
            ends = {w for w in self.words.words if w.endswith(words[0]) and len(words[0]) > 1}
            rest = [self.search(self.tails.get(w, {}), words[1:], most) for w in ends]
            full, inner = [x for f, _ in rest for x in f], [x for _, i in rest for x in i]
        else:
            full, inner = self.search(self.tails if begin_cut else self.root, words, most)
        best: dict[int, float] = {}
        for c, e in full:
            best[e] = min(c, best.get(e, 9.0))
        if best:
            return sorted((BY_WORDS, c, e) for e, c in best.items())
        for c, node in inner:
            for e, rest in self.below(node):
                if rest and (told or (rest not in self.rests and len(words) > 2)):
                    best[e] = min(c + 0.5, best.get(e, 9.0))
        return sorted((BY_PART, c, e) for e, c in best.items())

    def match(self, value: str) -> int:
        """The entry that is meant, or 0."""
        found = self.matches(value)
        return found[0][2] if found else 0


def load_tries(listed: DataFrame, shard_entries: int = SHARD_ENTRIES) -> list[VenueTrie]:
    """The list, read to the driver, as tries of ``shard_entries`` entries each; an empty list is one empty trie."""
    rows = listed.select("venue_id", "name", "acronym", "publisher").where("venue_id is not null").collect()
    entries = sorted((r.venue_id, r.name or "", r.acronym, r.publisher) for r in rows)
    whole = VenueList(entries)
    return [VenueTrie(entries[k : k + shard_entries], whole) for k in range(0, max(1, len(entries)), shard_entries)]


def _typed(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    return df.where(F.col(f"`{text}`").rlike(r"[^\s\x{A0}]")).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__typed"))


def all_entries(values: DataFrame, tries: list[VenueTrie], text: str = "__typed") -> DataFrame:
    """``text``, ``venue_id``, ``way``, ``distance`` of every entry within the distance of each distinct value of ``text``."""
    values = values.select(F.col(f"`{text}`").alias("typed")).where("typed is not null").distinct()

    def through(trie: VenueTrie) -> DataFrame:
        shipped = values.sparkSession.sparkContext.broadcast(trie)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = shipped.value
            for batch in batches:
                rows = [(v, i, way, d) for v in batch.column(0).to_pylist() for way, d, i in t.matches(v)]
                cols = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["typed", "venue_id", "way", "distance"])

        return values.mapInArrow(run, "typed string, venue_id long, way int, distance double")

    found = reduce(DataFrame.unionByName, map(through, tries))
    if len(tries) > 1:  # a shard that has no better way doesn't know that another has
        least = found.groupBy("typed").agg(F.min("way").alias("way"))
        found = found.join(least, ["typed", "way"])
    return found.select(F.col("typed").alias(text), "venue_id", "way", "distance")


def map_values(df: DataFrame, text: str, tries: list[VenueTrie], out: str = "venue_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all) of every row whose ``text`` is not blank, and the entry meant."""
    names = [c for c in (keep if keep is not None else df.columns) if c != out]
    src = _typed(df, text, names)
    if len(tries) > 1:
        best = all_entries(src, tries).groupBy("__typed").agg(F.min(F.struct("way", "distance", "venue_id")).alias("m")).select("__typed", F.col("m.venue_id").alias("__best"))
        return src.join(best, "__typed", "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce("__best", F.lit(0)).cast("long").alias(out))
    schema = T.StructType([*[src.schema[c] for c in names], T.StructField(out, T.LongType())])
    shipped = df.sparkSession.sparkContext.broadcast(tries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for batch in batches:
            code = batch.column(len(names)).dictionary_encode()
            ids = pa.array([t.match(v) for v in code.dictionary.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], ids.take(code.indices)], names=[*names, out])

    return src.mapInArrow(run, schema)


def unlisted(results: DataFrame, listed: DataFrame) -> DataFrame:
    """The records whose venue is neither null nor letter for letter a listed name."""
    return results.join(listed.select(F.col("name").alias("venue")).where("venue is not null"), "venue", "left_anti").where("venue is not null")


def map_venues(results: DataFrame, listed: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``obs_id``, ``venue``, ``venue_id`` (0: no entry) of every record whose venue is
    neither blank nor letter for letter a listed name."""
    return map_values(unlisted(results.select("obs_id", "venue"), listed), "venue", load_tries(listed, shard_entries), keep=["obs_id", "venue"])


def venue_candidates(results: DataFrame, listed: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``venue``, ``venue_id``, ``way``, ``distance``: all entries within the distance of each distinct venue typed."""
    return all_entries(unlisted(results.select("venue"), listed), load_tries(listed, shard_entries), "venue")
