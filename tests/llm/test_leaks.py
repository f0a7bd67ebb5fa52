import random

from scriptorium.llm.leaks import INTERRUPTION, QUOTE, SuffixAutomaton, chain, leaks, without_leaks


def brute_runs(items, words, least=4):
    """Maximal runs of the document, short ones if they stand in exactly one item."""
    def holders(g):
        return {k for k, w in items if any(tuple(w[i : i + len(g)]) == g for i in range(len(w) - len(g) + 1))}

    out = set()
    for q in range(len(words)):
        for n in range(least, len(words) - q + 1):
            g = tuple(words[q : q + n])
            h = holders(g)
            if not h:
                break
            longer = n < len(words) - q and holders(tuple(words[q : q + n + 1]))
            left = q and holders(tuple(words[q - 1 : q + n]))
            if (len({tuple(dict(items)[k]) for k in h}) == 1 or n > QUOTE) and not longer and not left:
                for k in h:
                    w = dict(items)[k]
                    out |= {(k, q, p, n) for p in range(len(w) - n + 1) if tuple(w[p : p + n]) == g}
    return out


def test_automaton_against_brute_force():
    r = random.Random(6)
    for _ in range(60):
        items = [(k, [r.choice("abcd") for _ in range(r.randrange(3, 14))]) for k in range(4)]
        items += [(4, items[0][1]), (5, items[1][1] + items[2][1] + items[3][1])]
        a = SuffixAutomaton(items)
        words = [r.choice("abcde") for _ in range(30)] + items[1][1] + items[2][1] + ["z"] + items[0][1]
        got = {(i, *x) for k, xs in a.runs(words).items() for x in xs for i in a.items[k]}
        assert got == brute_runs(items, words)


def brute_chain(runs, limit):
    """Over all chains: words covered and longest run."""
    runs, best = sorted(set(runs)), (0, 0)

    def go(j, covered, longest, wide):
        nonlocal best
        best = max(best, (covered, longest))
        q, p, n = runs[j]
        for k in range(j + 1, len(runs)):
            q2, p2, n2 = runs[k]
            lap, gap = max(0, p + n - p2, q + n - q2), q2 - (q + n)
            if p2 > p and q2 > q and lap < n2 and not (wide and gap > limit):
                go(k, covered + n2 - lap, max(longest, n2), wide or gap > limit)

    for j, r in enumerate(runs):
        go(j, r[2], r[2], False)
    return best


def test_chain_against_all_chains():
    r = random.Random(7)
    for _ in range(300):
        runs = [(r.randrange(120), r.randrange(30), r.randrange(4, 9)) for _ in range(r.randrange(1, 9))]
        covered, longest, spans = chain(runs, 12)
        assert covered == brute_chain(runs, 12)[0] and longest in {n for *_, n in runs}
        assert spans == sorted(spans) and all((q, b - q) in {(x, n) for x, _, n in runs} for q, b in spans)


def test_chain():
    assert chain([(10, 0, 5), (16, 6, 5)]) == (10, 5, [(10, 15), (16, 21)])
    assert chain([(10, 6, 5), (16, 0, 5)])[0] == 5  # out of order
    many = [(k * 40, 0, 30) for k in range(20_000)]  # the item again and again
    assert chain(many)[0] == 30


def test_one_interruption_of_any_length(spark):
    far = [(10, 0, 10), (5_000, 12, 10)]
    assert chain(far) == (20, 10, [(10, 20), (5_000, 5_010)])
    assert chain([*far, (9_000, 24, 10)])[0] == 20  # a second one is too many
    assert chain([*far, (5_015, 24, 10)])[0] == chain([(10, 0, 10), (25, 12, 10), (5_000, 24, 10)])[0] == 30
    w = ITEM.split()
    text = " ".join(w[:10]) + " filler" * 400 + " " + " ".join(w[12:22])
    d = spark.createDataFrame([(1, text), (2, " ".join(w[:10]) + " filler" * 400)], "doc_id int, text string")
    assert [r["doc_id"] for r in leaks(d, spark.createDataFrame([(77, ITEM)], "item_id int, text string")).collect()] == [1]
    assert INTERRUPTION < 400


def test_items_with_the_same_passages_and_shards(spark):
    w, short = ITEM.split(), "seven words of this small item stay"
    items = [(1, ITEM), (2, ITEM.upper()), (3, " ".join(w[:30]) + " and an end of its own with more words"), (4, OTHER), (5, short), (6, "Note that the results are reported in the table below"), (7, None)]
    docs = [(1, "x " + ITEM), (2, "x " + " ".join(w[:28])), (3, short + " " + short), (4, "seen before: " + OTHER + " " + ITEM), (5, "until the dawn of March while " * 4)]
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    want = {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (4, 1), (4, 2), (4, 3), (4, 4)}
    for words in (10_000, 40):  # one automaton, several
        assert {(r["doc_id"], r["item_id"]) for r in leaks(d, b, shard_words=words).collect()} == want


ITEM = "Clerks at Zeiberg recounted forty sensors until the dawn of March while Kranpredal painted every archive door in green and the harbour bell of Lospai rang eleven times before the quiet ferry to Bukfau left with nine crates of coarse ledgers"
OTHER = "Clerks at Nolman recounted sixty panels until the dawn of March while Gerova painted every archive wall in black and one more thing happened that nobody in the town of Welthal had ever seen or heard of before then at all"


def test_leaks(spark):
    w = ITEM.split()
    docs = {
        1: "Intro words here. " + ITEM + " And more.", 2: "x " + " ".join(w[:20]) + " end", 3: "x " + " ".join(w[:8]) + " end", 4: " ".join(w[:12]) + " an interruption of some words " + " ".join(w[14:30]),
        5: " ".join(w[:9] + ["changed"] + w[10:20] + ["too"] + w[21:]).upper(), 6: "Clerks at Somewhere recounted ninety panels until the dawn of March while Anyone painted every archive door in green", 7: None, 8: "", 9: "filler " * 20_000 + ITEM, 10: ITEM,
    }
    d = spark.createDataFrame([(k, t, 5) for k, t in docs.items()] + [(10, ITEM, 5)], "doc_id int, text string, item_id int")
    b = spark.createDataFrame([(77, ITEM), (78, OTHER), (79, None), (80, "")], "item_id int, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(d, b).collect())
    assert got == [(1, 77), (2, 77), (4, 77), (5, 77), (9, 77), (10, 77), (10, 77)]
    clean = {r["doc_id"]: r["text"] for r in without_leaks(d.where("doc_id in (1, 3)"), b).collect()}
    assert clean == {1: "Intro words here.  And more."}
    apart = spark.createDataFrame([(1, " ".join(w[:12]) + " words put in between " + " ".join(w[12:30]))], "doc_id int, text string")
    assert without_leaks(apart, b).first()["text"] == " words put in between "
    assert leaks(d.limit(0), b).collect() == [] and leaks(d, b.limit(0)).collect() == []
