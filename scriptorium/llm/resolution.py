"""Variant spellings of persons and organisations: merge-and-rematch resolution.

A profile is what is known of one entity: the union of the forms of all
spellings merged into it.  Every round puts profiles into blocks, scores the
pairs of a block, and merges nearest profiles: a profile joins the nearest one
unless it fits two that cannot be one entity, or the nearest one is as near to
something it cannot be.  A merged profile, richer by the other's spellings and
initials, re-enters the blocks in the next round; pairs of profiles that did not
change are not scored again.  Rounds go on until none merges anything.

Blocks.  Names are found by the words they hold.  Which surnames or words can be
one (a few edits, an abbreviation) is worked out once over the distinct words,
by signs that any two of them must share.  A person's block is a surname with a
first letter and the second initial; a profile that has but one initial meets
all of them.  An organisation's block is a word with the number of words, asked
for with the word of a name whose relatives are rarest, so that "University" and
"Press" call nobody.  The blocks lose no pair that the comparison would accept
(tests compare them with all pairs).  Pairs are rows of a join: no task gathers a block
or a component, and skewed blocks are split by the join.

Spellings that say the same (order, punctuation, accents, capitals, volume
numbers) fold into one form before any comparison, so blocks hold forms, not
rows.

Defined results: null, blank and undecidable spellings (a name without surname,
a venue without a word) belong to no entity; repeated rows count once; empty
tables give no row.  A form that fits several entities equally well stays alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packed import author_names
from ..session import materialize
from .names import Profile, at_odds, edits, near, parse_name, reach
from .truncation import Field, cut_values
from .venues import SHORT, Parsed, VenueTrie, load_tries, map_values, unlisted

SEP = "\t"
#: Words for a publishing house that its name may go without.
HOUSE = frozenset({"publishers", "publisher", "publishing", "publ"})
#: Words up to this length are found by deletions, longer ones by shared runs of GRAM letters.
LONG, GRAM = 24, 4
#: Scores that differ by no more are equal.
SLACK = 0.05


# ---- words that may be one


def signs(word: str, most: int) -> set[str]:
    """Signs of which any two words within ``most`` edits (a swap is one, ``rn`` for ``m`` too) share one.

    Two texts within k edits become the same by at most k deletions in each.  The
    deletions of a long text are too many; of its runs of ``GRAM`` letters an edit
    breaks ``GRAM`` + 1 at most, so three edits leave one.
    """
    found: set[str] = {word}
    for text, k in {(word, most), (word.replace("rn", "m"), most - 1)}:
        if k < 0:
            continue
        if len(text) <= LONG:
            level = {text}
            found |= level
            for _ in range(k):
                level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
                found |= level
        if len(text) >= LONG + 1 - 3:
            found |= {"#" + text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
    return found


def surname_signs(surname: str) -> set[str]:
    return signs(surname, reach(surname, surname))


def word_reach(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 6 else 2


@lru_cache(200_000)
def word_gap(a: str, b: str) -> float | None:
    """What it costs to read one word as the other: nothing, an abbreviation, or edits."""
    if a == b:
        return 0.0
    short, long = (a, b) if len(a) < len(b) else (b, a)
    if SHORT.get(short) == long or long.startswith(short):
        return 0.2
    most = word_reach(a, b)
    d = edits(a, b, most)
    if "rn" in a or "rn" in b:
        d = min(d, 1 + edits(a.replace("rn", "m"), b.replace("rn", "m"), most))
    return float(d) if d <= most else None


def word_signs(word: str) -> set[str]:
    """As :func:`signs`, and signs shared with the word's abbreviations."""
    found = {"-" + x for x in signs(word, word_reach(word, word))}
    return found | {"=" + word, *(("=" + SHORT[word],) if word in SHORT else ())}


def _prefixes(word: str) -> set[str]:
    return {"=" + word[:k] for k in range(1, len(word))}


def spread(df: DataFrame) -> DataFrame:
    """For stages whose cost is in the work, not in the bytes: enough partitions for all cores."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def relatives(tokens: DataFrame) -> DataFrame:
    """``a``, ``b``, ``d``: all pairs, both ways, of the distinct ``token``s (a kind's letter, then a
    word) that may be one, and every token with itself."""
    names = tokens.where("token is not null").select("token").distinct()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, bool]] = []
            for t in batch.column(0).to_pylist():
                kind, word = t[0], t[1:]
                rows += [(kind + s, t, True) for s in (surname_signs(word) if kind == "a" else word_signs(word))]
                rows += [(kind + s, t, False) for s in _prefixes(word)] if kind == "v" else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=["sign", "token", "own"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, d = [], [], []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gap = near(x[1:], y[1:]) if x[0] == "a" else word_gap(x[1:], y[1:])
                if gap is not None and gap < 99:
                    a += [x, y]
                    b += [y, x]
                    d += [float(gap)] * 2
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(d, pa.float64())], names=["a", "b", "d"])

    # A word meets those with its own signs, and those it is a beginning of; two beginnings never meet, so a letter calls nobody together.
    signed = spread(names).mapInArrow(sign, "sign string, token string, own boolean").select(F.xxhash64("sign").alias("sign"), "token", "own")
    a, b = signed.where("own").select("sign", F.col("token").alias("a")), signed.select("sign", F.col("token").alias("b"), "own")
    met = a.join(b.hint("merge"), "sign").where("a < b or (a > b and not own)")  # merge: the signs look small to the planner
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = pairs.mapInArrow(verify, "a string, b string, d double")
    return found.unionByName(names.select(F.col("token").alias("a"), F.col("token").alias("b"), F.lit(0.0).alias("d")))


# ---- persons


def person_form(spelling: str) -> str | None:
    name = parse_name(spelling)
    return None if name is None else SEP.join(("a", name.surname, name.initials, name.given))


@lru_cache(100_000)
def _said(sign: str) -> Profile:
    """The initials and given names a person's sign holds."""
    initials, _, givens = sign[1:].partition("|")
    return Profile(initials=set(initials.split(",")), givens=set(filter(None, givens.split(","))))


def person_sign(forms: list[str]) -> str:
    parts = [f.split(SEP) for f in forms]
    return "a" + ",".join(sorted({p[2] for p in parts})) + "|" + ",".join(sorted({p[3] for p in parts} - {""}))


def person_blocks(forms: list[str], sign: str) -> set[tuple[str, str, bool, bool]]:
    """(token, block, open, asks): every surname with every first letter; with the second initial, or open to all."""
    said = _said(sign)
    second = {i[1] for i in said.initials if len(i) > 1}
    blocks = {(lead + "*", not second) for lead in said.leads()} | {(lead + c, True) for lead in said.leads() for c in second}
    return {("a" + f.split(SEP)[1], block, opened, True) for f in forms for block, opened in blocks}


@lru_cache(500_000)
def _persons_apart(a: str, b: str) -> bool:
    return at_odds(_said(a), _said(b))


def person_score(a: str, b: str, d: float) -> float | None:
    """Edits between the surnames first, then whether the initials are the same somewhere."""
    same = bool(_said(a).initials & _said(b).initials)
    if (d > 1 and not same) or _persons_apart(*sorted((a, b))):
        return None
    return 2 * d + (not same)


# ---- organisations


def venue_form(trie: VenueTrie, value: str) -> str | None:
    parsed = Parsed(value)
    words = trie.names(parsed)
    if not words or sum(map(len, words)) < 4:
        return None
    flags = ("<" if parsed.begin_cut else "") + (">" if parsed.end_cut or parsed.dangling else "")
    return SEP.join(("v", "", flags, *words))


def whole_words(form: str) -> list[str]:
    """The words of a venue's form by which it may be asked for: not cut, and no word it may go without."""
    _, _, flags, *words = form.split(SEP)
    kept = words[1:] if flags == "<" else words[:-1] if flags == ">" else words
    return sorted({w for w in kept if w not in HOUSE} or set(kept) or set(words))


def venue_blocks(forms: list[str], sign: str) -> set[tuple[str, str, bool, bool]]:
    """(token, block, open, asks): every word with the number of words; a cut name is open to any number."""
    out = set()
    for f in forms:
        _, rare, flags, *words = f.split(SEP)
        sizes = {len(words)} | ({len(words) - 1} if HOUSE & set(words) else set())
        blocks = {("*", True)} if flags else {(str(n), True) for n in sizes} | {("*", False)}
        out |= {("v" + w, block, opened, w == rare) for w in set(words) for block, opened in blocks}
    return out


def _aligned(a: list[str], b: list[str]) -> float | None:
    total = 0.0
    for x, y in zip(a, b, strict=True):
        gap = word_gap(x, y)
        if gap is None:
            return None
        total += gap
    same = sum(x == y for x, y in zip(a, b, strict=True))
    most = 2.0 if same >= 2 or same * 2 >= len(a) else 1.0
    return total if total <= most + 0.2 * (len(a) - same) else None


def venue_gap(a: tuple[str, list[str]], b: tuple[str, list[str]]) -> float | None:
    """How far apart two forms of a venue are, None if they can't be one."""
    (fa, wa), (fb, wb) = a, b
    if len(wa) == len(wb):
        straight = _aligned(wa, wb)
        if straight is not None:
            return straight
        turned = _aligned(sorted(wa), sorted(wb)) if len(wa) > 2 and not (fa or fb) else None
        return None if turned is None else turned + 0.1
    if len(wa) > len(wb):
        fa, wa, fb, wb = fb, wb, fa, wa
    k = len(wa)
    if k < 2 or sum(map(len, wa)) < 8:
        return None
    for rest in (wb[:-1], wb[1:]):  # a house named without the word for what it is
        if len(rest) == k and not (set(wb) - set(rest)) - HOUSE and (gap := _aligned(wa, rest)) is not None:
            return gap + 0.3
    if ">" in fa and "<" not in fa and (gap := _aligned(wa, wb[:k])) is not None:
        return gap + 0.5
    if "<" in fa and ">" not in fa:
        if wb[-k].endswith(wa[0]) and (k == 1 or _aligned(wa[1:], wb[1 - k :]) is not None):
            return 0.5
        if (gap := _aligned(wa, wb[-k:])) is not None:
            return gap + 0.5
    return None


@lru_cache(100_000)
def _venue_parts(sign: str) -> list[tuple[str, list[str]]]:
    forms = [f.split(SEP) for f in sign[1:].split("\n")]
    return [(f[2], f[3:]) for f in forms]


@lru_cache(500_000)
def _venues_gap(a: str, b: str) -> float | None:
    found = [g for x in _venue_parts(a) for y in _venue_parts(b) if (g := venue_gap(x, y)) is not None]
    return min(found) if found else None


# ---- both kinds; a sign says what a comparison needs of a profile


def sign_of(forms: list[str]) -> str:
    return person_sign(forms) if forms[0][0] == "a" else "v" + "\n".join(sorted(forms))


def blocks_of(forms: list[str], sign: str) -> set[tuple[str, str, bool, bool]]:
    return person_blocks(forms, sign) if sign[0] == "a" else venue_blocks(forms, sign)


def score(a: str, b: str, d: float) -> float | None:
    return person_score(a, b, d) if a[0] == "a" else _venues_gap(*sorted((a, b)))


def apart(a: str, b: str) -> bool:
    """Whether two profiles can't be one entity, whatever else."""
    return _persons_apart(*sorted((a, b))) if a[0] == "a" else _venues_gap(*sorted((a, b))) is None


def _map(df: DataFrame, f: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """``df`` row by row through ``f`` in Arrow batches; ``f`` gives the rows that come of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for out in f(*row)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType.fromDDL(schema)
    names, arrow = kind.names, to_arrow_schema(kind)
    return df.mapInArrow(run, kind)


def _profiles(members: DataFrame) -> DataFrame:
    """``pid``, ``forms``, ``sign``: the forms of an entity are few, they are its distinct spellings folded."""
    sets = members.groupBy("pid").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    return _map(sets, lambda pid, forms: [(pid, forms, sign_of(forms))], "pid string, forms array<string>, sign string")


def _pairs(ask: DataFrame, answer: DataFrame, related: DataFrame) -> DataFrame:
    """``a``, ``b`` (pid and sign) and ``d`` of profiles that meet in a block."""
    blocks = lambda p: _map(p, lambda pid, forms, sign: [(pid, sign, *b) for b in sorted(blocks_of(forms, sign))], "pid string, sign string, token string, block string, opened boolean, asks boolean")
    x = blocks(ask).where("asks").select(F.struct("pid", "sign").alias("x"), F.col("token").alias("a"), "block", F.col("opened").alias("ox"))
    y = blocks(answer).select(F.struct("pid", "sign").alias("y"), F.col("token").alias("b"), "block", F.col("opened").alias("oy"))
    met = x.join(related, "a").join(y, ["b", "block"]).where("(ox or oy) and x.pid <> y.pid")
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("d").alias("d"))


def _scored(pairs: DataFrame) -> DataFrame:
    def run(a: str, sa: str, b: str, sb: str, d: float) -> list[tuple]:
        s = score(sa, sb, d)
        return [] if s is None else [(a, sa, b, sb, s)]

    flat = pairs.select("a.pid", F.col("a.sign").alias("sign"), F.col("b.pid").alias("other"), F.col("b.sign").alias("other_sign"), "d")
    return _map(flat, run, "pid string, sign string, other string, other_sign string, s double")


def _moves(scored: DataFrame) -> DataFrame:
    """``pid``, ``to``: the profiles that join a nearest one in this round."""
    turned = scored.select(F.col("other").alias("pid"), F.col("other_sign").alias("sign"), F.col("pid").alias("other"), F.col("sign").alias("other_sign"), "s")
    both = scored.unionByName(turned)
    least = both.groupBy("pid").agg(F.min("s").alias("least"))
    fits = both.join(least, "pid").where(F.col("s") <= F.col("least") + SLACK)
    best = fits.groupBy("pid", "sign").agg(F.min(F.struct("s", "other")).alias("m"), F.collect_set("other_sign").alias("rivals"))

    def judge(pid: str, sign: str, to: str, s: float, rivals: list[str]) -> list[tuple]:
        rivals = sorted(rivals)
        return [(pid, sign, to, s, rivals, any(apart(x, y) for k, x in enumerate(rivals) for y in rivals[:k]))]

    best = _map(best.select("pid", "sign", "m.other", "m.s", "rivals"), judge, "pid string, sign string, to string, s double, rivals array<string>, torn boolean")
    best = materialize(best)  # read three times

    def clear(pid: str, sign: str, to: str, s: float, rivals: list[str]) -> list[tuple]:
        return [] if any(r != sign and apart(sign, r) for r in rivals) else [(pid, sign, to, s)]

    nearest = best.where("not torn").select("pid", "sign", "to", "s").join(best.select(F.col("pid").alias("to"), "rivals"), "to")
    wish = materialize(_map(nearest.select("pid", "sign", "to", "s", "rivals"), clear, "pid string, sign string, to string, s double"))
    # A profile that wants to join another waits until that one has nowhere to go itself; of two that want each other the first stays.
    goes = wish.select(F.col("pid").alias("to"), F.col("to").alias("onward"))
    stays = F.col("onward").isNull() | ((F.col("onward") == F.col("pid")) & (F.col("to") < F.col("pid")))
    stars = wish.join(goes, "to", "left").where(stays).join(best.select(F.col("pid").alias("to"), F.col("sign").alias("centre")), "to")

    def absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, said = None, []
        for batch in batches:
            out = []
            for to, centre, pid, sign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to != at:
                    at, said = to, [centre]
                if not any(apart(sign, x) for x in said):
                    said.append(sign)
                    out.append((pid, to))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["pid", "to"])

    ordered = stars.repartition("to").sortWithinPartitions("to", "s", "pid").select("to", "centre", "pid", "sign")
    return ordered.mapInArrow(absorb, "pid string, to string")


def merge_and_rematch(forms: DataFrame, related: DataFrame) -> DataFrame:
    """``form`` and ``pid``, the entity it belongs to (a form of it), for the distinct ``form``s given;
    ``related`` as from :func:`relatives`.

    Every round but the last leaves fewer profiles, so the rounds end."""
    members = materialize(forms.where("form is not null").select("form").distinct().select("form", F.col("form").alias("pid")))
    profiles = materialize(_profiles(members))
    scored = materialize(_scored(_pairs(profiles, profiles, related)))
    while True:
        moved = materialize(_moves(scored))
        if moved.isEmpty():
            return members
        members = materialize(members.join(moved, "pid", "left").select("form", F.coalesce("to", "pid").alias("pid")))
        profiles = materialize(_profiles(members))
        changed = moved.select(F.col("to").alias("pid")).distinct()
        rich = profiles.join(changed, "pid", "left_semi")
        stale = changed.unionByName(moved.select("pid"))
        kept = scored.join(stale, "pid", "left_anti").join(stale.withColumnRenamed("pid", "other"), "other", "left_anti").select(*scored.columns)
        again = _pairs(rich, profiles, related).unionByName(_pairs(profiles, rich, related)).groupBy("a", "b").agg(F.min("d").alias("d"))
        scored = materialize(kept.unionByName(_scored(again)))


# ---- spellings


def _with_form(spellings: DataFrame, form: Callable[[str], str | None]) -> DataFrame:
    return _map(spellings.select("spelling"), lambda s: [(s, form(s))], "spelling string, form string").where("form is not null")


def with_rare_words(venues: DataFrame, words: DataFrame, related: DataFrame) -> DataFrame:
    """``venues`` (``spelling``, ``form``), each form with the word it is asked for by: the one whose
    relatives stand in fewest forms.  ``words``: ``form`` and ``token``, all of them."""
    held = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    weight = related.where("a like 'v%'").join(held.withColumnRenamed("token", "b"), "b").groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("n"))
    own = _map(venues.select("form").distinct(), lambda f: [(f, "v" + w) for w in whole_words(f)], "form string, token string")
    rare = own.join(weight, "token").groupBy("form").agg(F.min(F.struct("n", "token")).alias("m"))
    named = F.concat(F.lit("v" + SEP), F.substring("m.token", F.lit(2), F.length("m.token")), F.substring("form", F.lit(3), F.length("form")))
    return venues.join(rare, "form").select("spelling", named.alias("form"))


def author_spellings(results: DataFrame) -> DataFrame:
    """The distinct names out of ``authors`` values that were not cut."""
    cut = cut_values(results, fields=(Field("authors", lists=True),)).where("not cut_begin and not cut_end")
    whole = cut.select(F.col("value").alias("authors")).distinct().withColumn("byline", F.lit(None).cast("string"))
    return author_names(whole, keep=["authors"]).select(F.col("name").alias("spelling")).distinct()


def resolve_spellings(persons: DataFrame, organisations: DataFrame, trie: VenueTrie) -> DataFrame:
    """``kind``, ``spelling``, ``entity`` of the distinct ``spelling``s of both kinds."""
    shipped = persons.sparkSession.sparkContext.broadcast(trie)
    names = materialize(_with_form(persons, person_form))
    venues = materialize(_with_form(organisations, lambda v: venue_form(shipped.value, v)))
    words = materialize(_map(venues.select("form").distinct(), lambda f: [(f, "v" + w) for w in sorted(set(f.split(SEP)[3:]))], "form string, token string"))
    surnames = names.select(F.concat(F.lit("a"), F.split("form", SEP)[1]).alias("token"))
    related = materialize(relatives(surnames.unionByName(words.select("token"))))
    venues = materialize(with_rare_words(venues, words, related))
    spelled = names.unionByName(venues)
    found = merge_and_rematch(spelled.select("form"), related)
    kind = F.when(F.col("form").startswith("a"), "author").otherwise("venue")
    return spelled.join(found, "form").select(kind.alias("kind"), "spelling", F.col("pid").alias("entity"))


def entities(results: DataFrame, listed: DataFrame) -> DataFrame:
    """``kind`` ('author' or 'venue'), ``spelling``, ``entity``: the spellings of persons, and of
    venues that are not listed."""
    tries = load_tries(listed)
    typed = unlisted(results.select("venue").distinct(), listed)
    loose = map_values(spread(typed), "venue", tries, keep=["venue"]).where("venue_id = 0").select(F.col("venue").alias("spelling"))
    return resolve_spellings(author_spellings(results), loose, tries[0])


def variant_pairs(entities: DataFrame) -> DataFrame:
    """``kind``, ``name_a`` < ``name_b``: the pairs of spellings of one entity."""
    e = materialize(entities.distinct())
    a, b = e.withColumnRenamed("spelling", "name_a"), e.withColumnRenamed("spelling", "name_b")
    return a.join(b, ["kind", "entity"]).where("name_a < name_b").select("kind", "name_a", "name_b")
