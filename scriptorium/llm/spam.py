"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features.

Weak labels come from rules that only speak where a page is plain (a wall of
hashtags, of links, of repeated phrases; or running text).  They are asked of
every page; segments of a bounded sample of each label, drawn by a hash of the
key, train the trees; a log-odds table of words learned from the same sample is
one of their features.  Every page of the corpus is then cut into segments and
each segment is scored by the trees.  The score above which a segment is spam is
shifted by the spam rate of the page's host: on a host of spam the segments that
the trees leave open are spam, on a clean one they are not.  A page is spam if
the share of its text in spam segments is at least ``SHARE``.

Defined results: null and empty texts are no spam; a null host is a host of its
own; copies score alike but for their hosts; texts of any length are read whole;
a corpus without both labels finds nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bound of the training sample, in pages of each label (spam, none, silent); trees, their depth, segments of a leaf, spam segments of a bag.
SAMPLE_PAGES, TREES, DEPTH, LEAF, BAG = 1_000, 12, 7, 8, 1_500
#: Share of the text that makes a page spam; by how much a host of nothing but spam lowers the score of a spam segment; pages of prior.
SHARE, HOST_WEIGHT, PRIOR = 0.7, 0.15, 20.0
#: Scores at which a page's share is kept: the middle, as far as hosts can shift it, in steps of STEP.
LOW, STEP, CUTS = 0.3, 0.025, 17
#: Hosts whose rates are broadcast, at most.
SHIPPED_HOSTS = 100_000
WINDOW, LEAST_LABELS = 24, 4
#: Log-odds above which a word tells of spam; pages judged together, in characters.
TELLING, BATCH_CHARS = 1.5, 4_000_000

#: The commonest words of running text in four languages.
COMMON = frozenset(
    "the of and to in a is for on with as by at from that it be are was were which or an not this have has had but their its we our they he she his her been than then so if when while each most only "
    "der die das und den von zu mit ist im nicht ein eine auf dem des für sich sind wie auch als noch nach bei aus nur wird wurde einer eines zum zur "
    "la le les de et du un une est que pour dans sur par qui ne pas au aux ce ces cette nous il elle ils sont ont été plus "
    "el los las y en del por con una para se su al como no es son más este esta entre sus lo".split()
)
WORD = re.compile(r"\w+")
LINK = re.compile(r"\[[^\]\n]{0,200}\]\([^)\n]{0,400}\)|<a\b[^>]*>.*?</a>|<a\b[^>]*>|https?://[^\s<>\])]+|www\.[^\s<>\])]+", re.IGNORECASE | re.DOTALL)
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")
YEAR = re.compile(r"\b(?:1[5-9]|20)\d\d\b")
CODE = re.compile(r"[a-z]{2,5}\d{3,}")
FEATURES = ("common", "hashtags", "links", "odds", "repeated", "echo", "digits", "breaks", "ends", "words", "years", "codes", "page_echo", "page_links", "page_common", "page_variety")


def segments(text: str) -> list[str]:
    """Lines, sentences of long lines, and windows of words where there are neither."""
    out = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        parts = SENTENCE.split(line) if len(line) > 160 else [line]
        for part in parts:
            if len(part) <= 260:
                out.append(part)
                continue
            words = part.split(" ")
            out += [" ".join(words[k : k + WINDOW]) for k in range(0, len(words), WINDOW)]
    merged: list[str] = []
    for s in out:  # very short sentences say little alone
        if merged and len(s) < 40 and len(merged[-1]) < 160:
            merged[-1] += " " + s
        else:
            merged.append(s)
    return merged


def page_features(texts: list[str], odds: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment of the pages: its page, its length, and a row of :data:`FEATURES`.

    Words become numbers once; counts, sums and repeated pairs are array passes
    over all pages at a time.
    """
    page, parts, ids, sizes, vocabulary = [], [], [], [], defaultdict(count().__next__)
    number = vocabulary.__getitem__
    for k, text in enumerate(texts):
        for part in segments(text):
            words = WORD.findall(part.lower())
            page.append(k)
            parts.append(part)
            sizes.append(len(words))
            ids.extend(map(number, words))
    n_seg, n_page = len(parts), len(texts)
    if not n_seg:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(FEATURES)), np.float32)
    page_of = np.array(page, np.int64)
    word, size = np.array(ids, np.int64), np.array(sizes, np.int64)
    common = np.array([w in COMMON for w in vocabulary] or [False])
    digit = np.array([w.isdigit() for w in vocabulary] or [False])
    year = np.array([len(w) == 4 and w.isdigit() and "1500" <= w < "2100" for w in vocabulary] or [False])
    code = np.array([CODE.fullmatch(w) is not None for w in vocabulary] or [False])
    weight = np.array([odds.get(w, 0.0) for w in vocabulary] or [0.0])
    seg = np.repeat(np.arange(n_seg), size)
    doc = page_of[seg]
    v = max(1, len(vocabulary))
    per_seg = lambda x: np.bincount(seg, x, n_seg)
    per_doc = lambda x, at=doc: np.bincount(at, x, n_page)
    words_seg, words_doc = np.maximum(size, 1), np.maximum(np.bincount(doc, minlength=n_page), 1)
    key = doc * v + word
    kinds, where, times = np.unique(key, return_inverse=True, return_counts=True)
    rare = ~common[word]
    repeated = per_seg(rare & (times[where] > 3))
    distinct_doc = np.bincount(kinds // v, minlength=n_page)
    if len(word) > 1:
        left = np.flatnonzero(seg[1:] == seg[:-1])
        two = (word[left] * v + word[left + 1]) * 1_000_003 + doc[left]  # pairs of one page; a chance collision is harmless
        _, where2, times2 = np.unique(two, return_inverse=True, return_counts=True)
        again = (times2[where2] > 2).astype(float)
        echo_seg, echo_doc = np.bincount(seg[left], again, n_seg), np.bincount(doc[left], again, n_page)
    else:
        echo_seg, echo_doc = np.zeros(n_seg), np.zeros(n_page)
    length = np.array([len(p) for p in parts], np.float64)
    links = np.array([sum(len(m) for m in LINK.findall(p)) if "http" in p or "<a" in p or "www." in p else 0 for p in parts], np.float64)
    size_doc = np.maximum(np.bincount(page_of, length, n_page), 1)
    x = np.stack(
        [
            per_seg(common[word]) / words_seg,
            np.array([p.count("#") for p in parts]) / words_seg,
            links / length,
            per_seg(weight[word]) / words_seg,
            repeated / words_seg,
            echo_seg / words_seg,
            per_seg(digit[word]) / words_seg,
            np.array([p.count(",") + p.count(";") + p.count(" - ") + p.count("|") for p in parts]) / words_seg,
            np.array([p.rstrip()[-1:] in ".!?" for p in parts], np.float64),
            np.minimum(size, 60),
            np.minimum(per_seg(year[word]), 1),
            np.minimum(per_seg(code[word]), 1),
            (echo_doc / words_doc)[page_of],
            (np.bincount(page_of, links, n_page) / size_doc)[page_of],
            (per_doc(common[word]) / words_doc)[page_of],
            (distinct_doc / words_doc)[page_of],
        ],
        axis=1,
    ).astype(np.float32)
    return page_of, length, x


class Facts:
    """What the rules look at in a page, each worked out when a rule asks for it."""

    def __init__(self, text: str):
        self.text, self.words = text, WORD.findall(text.lower())
        self.n = max(1, len(self.words))

    @cached_property
    def common(self) -> float:
        return sum(w in COMMON for w in self.words) / self.n

    @cached_property
    def echo(self) -> float:
        return sum(c for c in Counter(zip(self.words, self.words[1:])).values() if c > 2) / self.n

    @cached_property
    def links(self) -> float:
        some = any(x in self.text for x in ("](", "<a", "<A", "://", "www.", "WWW."))
        return sum(len(m) for m in LINK.findall(self.text)) / max(1, len(self.text)) if some else 0.0

    @cached_property
    def full(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip()]

    @cached_property
    def lines(self) -> int:
        return len(self.full)

    @cached_property
    def dated(self) -> float:
        return sum(YEAR.search(x) is not None for x in self.full) / max(1, self.lines)

    @cached_property
    def tags(self) -> float:
        return self.text.count("#") / self.n

    @cached_property
    def codes(self) -> float:
        return sum(CODE.fullmatch(w) is not None for w in self.words) / max(1, self.lines)

    @cached_property
    def variety(self) -> float:
        return len(set(self.words)) / self.n


facts = Facts


def weak_label(f: Facts, odds: dict[str, float] | None = None) -> int | None:
    """1 where a page is plainly spam, 0 where it is plainly none, None where the rules are silent.

    ``odds``: what the words of pages labelled before say; pages full of the words
    of spam are spam of another form.
    """
    n = len(f.words)
    if n < 12:
        return None
    if f.common < 0.05 and (f.tags > 0.35 or (f.links > 0.85 and f.dated < 0.3) or (f.codes > 0.8 and f.dated < 0.3)):
        return 1
    if f.common < 0.14 and f.echo > 0.55 and f.dated < 0.2:
        return 1
    if f.common < 0.035 and f.variety < 0.45 and n > 40 and f.dated < 0.2:
        return 1
    telling = sum(odds.get(w, 0.0) > TELLING for w in f.words) / n if odds else 0.0
    if telling > 0.3 and f.echo > 0.15 and f.dated < 0.3:
        return 1
    if not f.tags and f.lines > 3 and f.dated > 0.6 and f.echo < 0.4:
        return 0
    if telling > 0.1:
        return None
    return 0 if f.common > 0.15 and not f.tags and f.links < 0.1 and f.echo < 0.25 else None


@dataclass
class Tree:
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            f = self.feature[at]
            go = f >= 0
            if not go.any():
                break
            left = x[np.arange(len(x)), np.maximum(f, 0)] <= self.cut[at]
            at = np.where(go, np.where(left, self.low[at], self.high[at]), at)
        return self.value[at]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree by Gini impurity over a random third of the features at every node, cuts at quantiles."""
    nodes: list[list] = []

    def node(rows: np.ndarray, depth: int) -> int:
        k = len(nodes)
        mean = float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, mean])
        if depth >= DEPTH or len(rows) < 2 * LEAF or mean in (0.0, 1.0):
            return k
        best = (2 * mean * (1 - mean) - 1e-4, -1, 0.0)
        for f in rng.choice(x.shape[1], max(3, x.shape[1] // 3), replace=False):
            v = x[rows, f]
            for c in np.unique(np.quantile(v, np.linspace(0.04, 0.96, 16))):
                left = v <= c
                a = int(left.sum())
                if LEAF <= a <= len(rows) - LEAF:
                    p, q = y[rows[left]].mean(), y[rows[~left]].mean()
                    gini = (a * 2 * p * (1 - p) + (len(rows) - a) * 2 * q * (1 - q)) / len(rows)
                    if gini < best[0]:
                        best = (gini, int(f), float(c))
        if best[1] >= 0:
            left = x[rows, best[1]] <= best[2]
            nodes[k][0], nodes[k][1] = best[1], best[2]
            nodes[k][2] = node(rows[left], depth + 1)
            nodes[k][3] = node(rows[~left], depth + 1)
        return k

    node(np.arange(len(y)), 0)
    cols = list(zip(*nodes, strict=True))
    return Tree(np.array(cols[0], np.int64), np.array(cols[1], np.float32), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4], np.float32))


@dataclass
class Model:
    odds: dict[str, float]
    trees: list[Tree]

    def judge(self, x: np.ndarray) -> np.ndarray:
        return sum(t.predict(x) for t in self.trees) / len(self.trees)

    def shares(self, texts: list[str]) -> np.ndarray:
        """For each page the share of its text in segments that score at least each of the cuts."""
        share = np.zeros((len(texts), CUTS))
        if not self.trees:
            return share
        cuts = LOW + STEP * np.arange(CUTS) - 1e-9
        start, chars = 0, 0
        for k in range(len(texts) + 1):
            if k == len(texts) or chars > BATCH_CHARS:
                page, size, x = page_features(texts[start:k], self.odds)
                if len(page):
                    n = k - start
                    above = np.searchsorted(cuts, self.judge(x), side="right")  # cuts that the segment reaches
                    held = np.bincount(page * (CUTS + 1) + above, size, n * (CUTS + 1)).reshape(n, CUTS + 1)
                    total = np.maximum(held.sum(axis=1, keepdims=True), 1)
                    share[start:k] = (held[:, ::-1].cumsum(axis=1)[:, ::-1] / total)[:, 1:]
                start, chars = k, 0
            if k < len(texts):
                chars += len(texts[k])
        return share


def _odds(pages: list[Facts], labels: list[int | None]) -> dict[str, float]:
    seen, n = {0: Counter(), 1: Counter()}, Counter(labels)
    for f, k in zip(pages, labels, strict=True):
        if k is not None:
            seen[k].update(set(f.words))
    return {
        w: max(-4.0, min(4.0, math.log(((seen[1][w] + 0.5) / (n[1] + 1)) / ((seen[0][w] + 0.5) / (n[0] + 1)))))
        for w in set(seen[0]) | set(seen[1])
        if seen[0][w] + seen[1][w] >= 5
    }


def train(texts: list[str], seed: int = 7) -> Model:
    """The model of a labelled sample; without both labels one that finds nothing."""
    pages, odds = [facts(t) for t in texts], {}
    for _ in range(3):  # the words of the labelled pages label more pages
        labels = [weak_label(f, odds) for f in pages]
        if min(labels.count(0), labels.count(1)) < LEAST_LABELS:
            return Model({}, [])
        odds = _odds(pages, labels)
    known = [(t, k) for t, k in zip(texts, labels, strict=True) if k is not None]
    page, _, x = page_features([t for t, _ in known], odds)
    y = np.array([k for _, k in known], np.float64)[page]
    # In a spam page only what looks it is surely spam; sentences put in between are left out.
    sure = (x[:, 3] > 0.3) | (x[:, 2] > 0.5) | (x[:, 1] > 0.3) | (x[:, 5] > 0.5) | (x[:, 11] > 0)
    x, y = x[(y == 0) | sure], y[(y == 0) | sure]
    rng = np.random.default_rng(seed)
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    alike = zeros[(x[zeros, 2] > 0.05) | (x[zeros, 0] < 0.15) | (x[zeros, 10] > 0)]  # lists of sources, programmes and the like
    trees = []
    for _ in range(TREES):
        m = min(BAG, len(ones))
        bag = np.concatenate([rng.choice(ones, m), rng.choice(zeros, m), rng.choice(alike, m) if len(alike) else ones[:0]])
        trees.append(grow(x[bag], y[bag], rng))
    return Model(odds, trees)


def weak_labels(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``label`` (2 where the rules are silent) and ``h``, a number drawn by the key, of every page with a text."""
    spread = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("spam")), F.lit(1 << 40))
    src = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), spread.alias("h"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weak_label(facts(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([2 if k is None else k for k in found], pa.int32())], names=["key", "h", "label"])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, h long, label int")


def train_on(documents: DataFrame, key: str = "doc_id", text: str = "text", sample_pages: int = SAMPLE_PAGES) -> Model:
    """Trained on about ``sample_pages`` pages of each label, those whose number is below the share that makes so many.

    Only the sample goes to the driver: at most twice ``sample_pages`` of each label, however large the corpus is;
    a label that is rare in it is taken whole.
    """
    labels = materialize(weak_labels(documents, key, text))
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < LEAST_LABELS:
        return Model({}, [])
    drawn = [labels.where((F.col("label") == k) & (F.col("h") < F.lit(int(min(1.0, sample_pages / n) * (1 << 40))))).limit(2 * sample_pages) for k, n in sorted(counts.items())]
    keys = reduce(DataFrame.unionByName, drawn).select("key", "h").distinct()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("t")).join(F.broadcast(keys), "key").where("t is not null").groupBy("key", "h").agg(F.min("t").alias("t")).collect()
    return train([r["t"] for r in sorted(rows, key=lambda r: (r["h"], r["t"]))])


def page_shares(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key``, ``source``, ``shares`` (at each cut): every page judged, where it is read."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    src = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            shares = m.shares(batch.column(2).to_pylist())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, CUTS), pa.int32()), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], names=["key", "source", "shares"])

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, source string, shares array<double>").withColumnRenamed("key", key)


def smoothed(pages: DataFrame, key: str = "doc_id", share: float = SHARE) -> DataFrame:
    """``key``, ``source``, ``share`` (by the trees alone), ``score`` (the share with the host's cut), ``host_rate``, ``is_spam``.

    A host's rate is the share of its pages that the trees alone find spam, drawn to the rate of all pages by ``PRIOR``.
    """
    alone = F.get("shares", F.lit(round((0.5 - LOW) / STEP)))
    pages = pages.select(key, "source", F.coalesce("source", F.lit("")).alias("host"), "shares", alone.alias("share"))
    hosts = pages.groupBy("host").agg(F.sum((F.col("share") >= share).cast("double")).alias("spam"), F.count(F.lit(1)).alias("n"))
    hosts = materialize(hosts)
    n_spam, n_pages, n_hosts = hosts.agg(F.sum("spam"), F.sum("n"), F.count(F.lit(1))).first()  # one row
    base = (n_spam or 0.0) / n_pages if n_pages else 0.0
    rates = hosts.select("host", ((F.col("spam") + PRIOR * base) / (F.col("n") + PRIOR)).alias("host_rate"))
    out = pages.join(F.broadcast(rates) if n_hosts <= SHIPPED_HOSTS else rates, "host")
    cut = F.greatest(F.least(F.ceil(F.round((0.5 - HOST_WEIGHT * (F.col("host_rate") - base) - LOW) / STEP, 6)), F.lit(CUTS - 1)), F.lit(0)).cast("int")
    out = out.withColumn("score", F.get("shares", cut))
    return out.select(key, "source", "share", "score", "host_rate", (F.col("score") >= share).alias("is_spam"))


def spam_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE) -> DataFrame:
    """As :func:`smoothed`, for every page of ``documents``."""
    return smoothed(materialize(page_shares(documents, train_on(documents, key, text), key, text, source)), key, share)
