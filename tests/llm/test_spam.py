import random

from scriptorium.llm.spam import CUTS, LOW, STEP, facts, page_features, segments, smoothed, spam_pages, train, train_on, weak_label

KEYS = ["proof reading", "essay tutor", "bulk pdf", "ghost author", "rank tool", "exam notes"]
TOPICS = ["reef optics", "kelp genomics", "moss ethics", "dune anatomy"]
NOUNS = "archive survey margin index plot sensor panel cohort basin ledger".split()


def prose(r, n):
    out = []
    for _ in range(n):
        a, b, c = (r.choice(NOUNS) for _ in range(3))
        out.append(r.choice([f"The {a} was measured against the {b} of {r.choice(TOPICS)}, and so it was revised in {r.randrange(1950, 2020)}.", f"In this study we have compared {a}s from a {b} with those of the {c}.", f"What counts as {a} in {r.choice(TOPICS)} depends on the {b} that they had at the time."]))
    return " ".join(out)


def junk(r, n):
    kind = r.randrange(5)
    key = lambda: r.choice(KEYS)
    if kind == 0:
        return " ".join("#" + key().title().replace(" ", "") for _ in range(n * 5))
    if kind == 1:
        return "\n".join(f"[{key()} {r.choice(TOPICS)}](http://{r.choice(NOUNS)}{r.randrange(99)}.example/{r.randrange(999)})" for _ in range(n * 2))
    if kind == 2:
        return " ".join(r.choice(["buy", "cheap", "best", "online", key(), key(), r.choice(TOPICS)]) for _ in range(n * 8))
    if kind == 3:
        return "\n".join(f"{r.choice(TOPICS).title()} - {key()} - SKU{r.randrange(10**4, 10**5)} - tags: {key()}, cheap, {key()}" for _ in range(n))
    k = key()
    return " ".join(f"We offer {k}, {key()} and {k} in Town{r.randrange(99)}. Why {k}? Because {k} is {k}." for _ in range(n))


def sources(r, n):
    return "Sources\n" + "\n".join(f"{chr(65 + r.randrange(26))} {r.choice(NOUNS).title()}, {r.choice(TOPICS).title()}: a {r.choice(NOUNS)} of {r.choice(NOUNS)}s, {r.randrange(1950, 2020)}, https://lib.example/w/{r.randrange(10**4)}" for _ in range(n))


def corpus(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = i % 8
        if k == 0:
            out.append((junk(r, 12), 1))
        elif k == 1:
            out.append((prose(r, 1) + "\n" + junk(r, 14), 1))
        elif k == 2:
            out.append((prose(r, 12) + "\n" + "Keywords: " + "; ".join(r.choice(TOPICS) for _ in range(4)), 0))
        elif k == 3:
            out.append((sources(r, 10), 0))
        else:
            out.append((prose(r, r.randrange(3, 14)), 0))
    return out


def test_held_out_accuracy():
    model = train([t for t, _ in corpus(1, 1200)])
    held = corpus(2, 600)
    share = model.shares([t for t, _ in held])[:, round((0.5 - LOW) / STEP)]
    wrong = [(y, round(s, 2)) for s, (_, y) in zip(share, held, strict=True) if (s >= 0.7) != y]
    assert len(wrong) <= 12, wrong


def test_parts():
    assert segments("") == [] and segments(" \n ") == []
    assert sum(map(len, segments("word " * 3000))) > 14_000
    page, size, x = page_features(["", "a b c", "#x " * 30], {})
    assert list(page) == [1, 2] or set(page) == {1, 2}
    assert len(size) == len(x) == len(page)
    assert weak_label(facts("too short")) is None
    empty = train([])
    assert empty.trees == [] and not empty.shares(["anything"]).any()


def test_pages(spark):
    rows = [(i, t, f"h{i % 5}.example" if i % 7 else None, "clash") for i, (t, _) in enumerate(corpus(3, 400))] + [(900, None, None, "x"), (901, "", "h1.example", "x"), (902, "  ", None, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, share string")
    got = {r["doc_id"]: r["is_spam"] for r in spam_pages(df).collect()}
    assert len(got) == 403 and not any(got[k] for k in (900, 901, 902))
    truth = {i: bool(y) for i, (_, y) in enumerate(corpus(3, 400))}
    assert sum(got[i] != truth[i] for i in truth) <= 10
    assert spam_pages(df.limit(0)).collect() == []


def test_hosts_decide_what_the_trees_leave_open(spark):
    # four fifths of the page scores 0.45: spam on a host of spam, none elsewhere; 0.55: spam but on a clean host
    at = lambda score: [0.8 if LOW + STEP * k <= score + 1e-9 else 0.0 for k in range(CUTS)]
    rows = [(k, "bad", [1.0] * CUTS) for k in range(60)] + [(100 + k, "good", [0.0] * CUTS) for k in range(300)]
    rows += [(1, "bad", at(0.45)), (2, "good", at(0.45)), (3, None, at(0.45)), (4, "bad", at(0.5)), (5, "good", at(0.5)), (6, "good", at(0.6))]
    df = spark.createDataFrame([r for r in rows if r[0] > 6 or r[2] not in ([1.0] * CUTS,)], "doc_id int, source string, shares array<double>")
    got = {(r["doc_id"], r["source"]): r for r in smoothed(df).collect()}
    assert [got[k]["is_spam"] for k in ((1, "bad"), (2, "good"), (3, None), (4, "bad"), (5, "good"), (6, "good"))] == [True, False, False, True, False, True]
    assert got[1, "bad"]["share"] < 0.7 <= got[1, "bad"]["score"] and got[5, "good"]["share"] >= 0.7 > got[5, "good"]["score"]


def test_rare_spam_is_sampled_whole(spark):
    r = random.Random(5)
    rows = [(i, prose(r, 3)) for i in range(3_000)] + [(9_000 + i, junk(r, 12)) for i in range(30)]
    model = train_on(spark.createDataFrame(rows, "doc_id int, text string"), sample_pages=60)
    assert model.trees and model.shares([junk(r, 12)])[0, 8] > 0.7
