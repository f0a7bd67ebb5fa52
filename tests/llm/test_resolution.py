"""The resolver against all pairs, and on hand-made cases."""

import random

import pytest

from scriptorium.llm.names import edits, near, parse_name
from scriptorium.llm.resolution import _pairs, _profiles, _scored, entities, relatives, resolve_spellings, score, sign_of, surname_signs, variant_pairs, venue_form, whole_words, with_rare_words, word_gap
from scriptorium.llm.venues import VenueTrie


def test_parse():
    p = lambda t: (n := parse_name(t)) and (n.surname, n.initials, n.given)
    assert p("P Rieholm") == p("Rieholm, P.") == p("RIEHOLM P") == p("Rieholm P") == ("rieholm", "p", "")
    assert p("K. O. Triediby") == p("Triediby, KO") == ("triediby", "ko", "")
    assert p("Jean-Luc Forzén") == ("forzen", "jl", "jeanluc")
    assert p("Isabella H. Pupelby-Sket") == p("Pupelby-Sket, Isabella H.") == ("pupelbysket", "ih", "isabella")
    assert p("van der Treisund, Sasha") == ("vandertreisund", "s", "sasha")
    assert p("Rieholm") is None and p("KO") is None and p("") is None


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "acb", 1), ("abcd", "abd", 1), ("kitten", "sitting", 3), ("", "ab", 2)])
def test_edits(a, b, d):
    assert edits(a, b, 5) == d and (d == 0 or edits(a, b, d - 1) == d)


def grouped(spark, persons=(), venues=()):
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "spelling string")
    got = {}
    for r in resolve_spellings(frame(persons), frame(venues), VenueTrie([])).collect():
        got.setdefault(r["entity"], set()).add(r["spelling"])
    return sorted(sorted(g) for g in got.values())


def test_merge_and_rematch(spark):
    one = [["P Rieholm", "Pavel Ríehöłm", "P Riehollrn"], ["YJ Rieholm"], ["CN Rieholm"]]
    other = [["KO Schelsund", "KO Schelsúnd"], ["FM Schelsund", "SCHELSUND F"], ["Dick Gaurinnik", "RH Gaurinnik", "Richard Gaurinnik"]]
    alone = [["R Forzen"], ["Rebecca Forzen"], ["Richard Forzen"]]  # R may be either
    rich = [["I Klerfausen", "I Klerrfause", "Isabella Klerrfause"]]  # only the merged profile of the first two says that the third fits
    chain = [["A Korpelainen", "A Korpelaimen", "A Korpelaimer", "A Korbelaimer", "A Gorbelaimer", "A Gorbelaimet"]]  # each is near the next only
    houses = [["Dagron Univ. Press", "Dagron University Press", "Press of Dagron University"], ["Zelmark & Sons", "Zelmark & Sons Publishers"], ["Quorlin Institute Technical Reports", "Quorlin Institute Technical Rep…"], ["Brundle Academy Notes"]]
    persons = [*one, *other, *alone, *rich, *chain]
    assert grouped(spark, [x for g in persons for x in g], [x for g in houses for x in g]) == sorted(sorted(g) for g in persons + houses)


def all_pairs(forms):
    out = set()
    for n, a in enumerate(forms):
        for b in forms[:n]:
            d = near(a.split("\t")[1], b.split("\t")[1]) if a[0] == "a" else 0.0
            if d < 99 and (s := score(*sorted((sign_of([a]), sign_of([b]))), d)) is not None:
                out.add((*sorted((a, b)), float(s)))
    return out


def test_blocks_lose_no_pair_of_persons(spark):
    r = random.Random(8)
    roots = ["rieholm", "schelsund", "gaurinnik", "klerfausen", "wainvenwald", "lund", "morn"]

    def typo(s):
        k = r.randrange(len(s))
        return r.choice([s, s[:k] + s[k + 1 :], s[:k] + r.choice("aemnr") + s[k:], s[:k] + s[k : k + 2][::-1] + s[k + 2 :], s.replace("m", "rn", 1)])

    forms = set()
    for _ in range(260):
        given = r.choice(["", "", "richard", "dick", "rebecca", "robert", "bob"])
        initials = (given[:1] or r.choice("rdb")) + r.choice(["", "", "h", "k", "hk"])
        forms.add(f"a\t{typo(typo(r.choice(roots)))}\t{initials}\t{given}")
    compare(spark, sorted(forms), relatives(spark.createDataFrame([("a" + f.split("\t")[1],) for f in forms], "token string")))


def test_blocks_lose_no_pair_of_organisations(spark):
    r = random.Random(9)
    words = ["University", "Press", "Institute", "Technical", "Reports", "Dagron", "Quorlin", "Zelmark", "Sons", "Publishers", "Academy", "Notes", "Kiln", "Genomics"]

    def typed(w):
        k = r.randrange(1, len(w))
        return r.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("aeo") + w[k:], w[: r.randrange(1, 5)] + "."])

    values = []
    for _ in range(300):
        v = [typed(w) for w in r.sample(words, r.choice([2, 3, 3, 4]))]
        values.append(r.choice(["{}", "{}", "{}", "… {}", "{}…"]).format(" ".join(v)))
    trie = VenueTrie([])
    forms = sorted({f for v in values if (f := venue_form(trie, v))})
    held = spark.createDataFrame([(f, "v" + w) for f in forms for w in set(f.split("\t")[3:])], "form string, token string")
    related = relatives(held.select("token"))
    tokens = sorted({t for f in forms for t in f.split("\t")[3:]})
    want = {("v" + a, "v" + b) for a in tokens for b in tokens if word_gap(a, b) is not None}
    assert {(x["a"], x["b"]) for x in related.collect()} == want
    rare = with_rare_words(spark.createDataFrame([(f, f) for f in forms], "spelling string, form string"), held, related)
    forms = sorted(x["form"] for x in rare.collect())
    assert all(f.split("\t")[1] in whole_words(f) for f in forms)
    compare(spark, forms, related)


def compare(spark, forms, related):
    profiles = _profiles(spark.createDataFrame([(f, f) for f in forms], "form string, pid string"))
    got = _scored(_pairs(profiles, profiles, related)).collect()
    want = all_pairs(forms)
    assert {(x["pid"], x["other"], x["s"]) for x in got} == want and len(got) == len(want) > 40


def test_near_surnames_share_a_sign():
    r, hits = random.Random(3), 0
    for _ in range(3_000):
        a = b = "".join(r.choice("abmnr") for _ in range(r.choice([4, 5, 6, 8, 11, 13, 23, 25, 30])))
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(b))
            b = r.choice([b[:k] + b[k + 1 :], b[:k] + r.choice("abm") + b[k:], b[:k] + r.choice("abm") + b[k + 1 :], b[:k] + b[k : k + 2][::-1] + b[k + 2 :], b.replace("rn", "m", 1)])
        if near(a, b) < 99:
            hits += 1
            assert surname_signs(a) & surname_signs(b), (a, b)
    assert hits > 1_000


def test_edits_near_both_ends_are_linked(spark):
    names = ["R Pinnerka", "R Pnnerea", "A Klenrath", "A Klnersth", "B Klnersth"]
    rows = [(i, n, "byline", None, "http://x.example/1") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "obs_id int, authors string, byline string, venue string, link string")
    listed = spark.createDataFrame([(1, "Annals of Reef Optics", None, None)], "venue_id long, name string, acronym string, publisher string")
    got = {tuple(r) for r in variant_pairs(entities(df, listed)).collect()}
    assert got == {("author", "R Pinnerka", "R Pnnerea"), ("author", "A Klenrath", "A Klnersth")}


def test_pairs(spark):
    lists = ["P Rieholm; KO Schelsund", "Rieholm, P.; Schelsund, KO", "P Rieholm, Dick Gaurinnik", "RH Gaurinnik", "P Rieholm, KO Schels…", None, ""]
    venues = ["Dagron University Press", "Dagron Univ. Press", "DAGRON UNIVERSITY PRESS", "Press of Dagron University", "Annals of Reef Optics", "annals of reef optics 3", "PhD thesis", None]
    rows = [(i, lists[i % 7], "byline", venues[i % 8], "http://x.example/1", "kind", "form") for i in range(56)]
    df = spark.createDataFrame(rows, "obs_id int, authors string, byline string, venue string, link string, kind string, form string")
    listed = spark.createDataFrame([(1, "Annals of Reef Optics", None, None)], "venue_id long, name string, acronym string, publisher string")
    got = {tuple(r) for r in variant_pairs(entities(df, listed)).collect()}
    press = sorted(venues[:4], key=lambda t: t.encode())
    want = {("venue", a, b) for i, a in enumerate(press) for b in press[i + 1 :]}
    want |= {("author", "P Rieholm", "Rieholm, P."), ("author", "KO Schelsund", "Schelsund, KO"), ("author", "Dick Gaurinnik", "RH Gaurinnik")}
    assert got == want
    assert variant_pairs(entities(df.limit(0), listed)).collect() == []
