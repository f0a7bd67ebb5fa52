import random
from collections import Counter, defaultdict

import pytest

from scriptorium.llm.packing import TOKENIZER, pack, pack_documents, packing_report, plan, token_sizes, tokenizer


def test_plan_properties():
    r = random.Random(1)
    for _ in range(200):
        cap = r.choice([10, 37, 100])
        counts = {r.randint(1, cap): r.randint(1, 30) for _ in range(r.randint(1, 25))}
        used, seen = Counter(), Counter()
        for size, lo, hi, first, per in plan(counts, cap):
            for rank in range(lo, hi + 1):
                used[first + (rank - lo) // per] += size
                seen[size, rank] += 1
        assert max(used.values()) <= cap and sorted(used) == list(range(len(used)))
        assert seen == Counter({(s, k): 1 for s, n in counts.items() for k in range(1, n + 1)})
        if len(used) > 1:  # any two containers together hold more than one could
            low = sorted(used.values())[:2]
            assert sum(low) > cap


@pytest.mark.parametrize("cap", [16, 50])
def test_pack(spark, cap):
    r = random.Random(cap)
    sizes = {f"d{i}": r.choice([0, 1, 2, 3, 5, 5, 5, 8, 13, 40, 16, 50, 100, 137]) for i in range(400)}
    df = spark.createDataFrame([(k, s, "x", 1) for k, s in sizes.items()], "doc_id string, size long, container string, piece int").select("doc_id", "size")
    rows = pack(df, "doc_id", "size", cap, salts=cap // 10).collect()
    used, pieces = Counter(), defaultdict(list)
    for x in rows:
        pieces[x["doc_id"]].append((x["piece"], x["start"], x["size"], x["container"]))
        if x["container"] is not None:
            used[x["container"]] += x["size"]
    assert max(used.values()) <= cap and sorted(used) == list(range(len(used)))
    for k, s in sizes.items():
        ps = sorted(pieces[k])
        assert sum(p[2] for p in ps) == s and [p[0] for p in ps] == list(range(len(ps))) and all(p[1] == i * cap for i, p in enumerate(ps))
        assert len(ps) == max(1, -(-s // cap)) and (s > 0 or ps[0][3] is None)
    assert len(used) <= sum(sizes.values()) / cap * 1.1 + 1


def test_texts(spark):
    pytest.importorskip("tiktoken")
    texts = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 5000), (5, "ünïcode ☃ 日本")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r["doc_id"]: r["size"] for r in token_sizes(df).collect()}
    e = tokenizer(TOKENIZER)
    assert got == {k: len(e.encode_ordinary(t or "")) for k, t in texts} and e.decode(e.encode_ordinary("a b\n\n c")) == "a b\n\n c"
    p = pack_documents(df)
    assert {r["doc_id"] for r in p.collect()} == {1, 2, 3, 4, 5}
    report = packing_report(p).first()
    assert report["n_tokens"] == sum(got.values()) and report["most_used"] <= 2048
    assert pack_documents(df.limit(0)).collect() == []
