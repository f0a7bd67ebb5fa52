import random
import time

import pyarrow as pa
import pytest

from scriptorium.llm.topn import LoserTree, Run, _best, merge_runs, top_n


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s):
            best[g, i] = max(s, best.get((g, i), s))
    out = []
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
        out += [(g, i, -s, k + 1) for k, (s, i) in enumerate(ranked)]
    return sorted(out)


def run_of(rows):
    rows = sorted(rows, key=lambda r: (r[0], -r[2], r[1]))
    return Run(pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()))


def test_loser_tree_merges_sorted_runs():
    r = random.Random(1)
    for _ in range(60):
        runs = [[(r.choice("abc"), str(r.randrange(6)), r.randrange(5)) for _ in range(r.randrange(8))] for _ in range(r.randrange(7))]
        for n in (1, 3, 100):
            got = list(merge_runs([run_of(x) for x in runs], n))
            assert [(g, i, s, k) for g, s, i, k in got] == sorted(brute([x for run in runs for x in run], n), key=lambda x: (x[0], x[3]))
    assert LoserTree([]).winner == -1 and list(merge_runs([], 3)) == [] and list(merge_runs([run_of([("a", "x", 0)])], 0)) == []


def test_runs_seek_past_a_group():
    run = run_of([("a", str(k), k) for k in range(1_000)] + [("b", "x", 1)])
    assert [x[2] for x in merge_runs([run], 2)] == ["999", "998", "x"]
    run = run_of([("a", str(k), k) for k in range(1_000)] + [("b", "x", 1)])
    run.seek_past("a")
    assert run.head == ("b", -1, "x") and run.at == 1_000


@pytest.mark.parametrize("n", [1, 3, 50])
def test_against_brute_force(spark, n):
    r = random.Random(n)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", "", None, "é", "z"]), r.choice([None, *map(str, range(40))]), r.choice([None, 0, 1, 1, 2, 3, 10**12])) for _ in range(900)]
    df = spark.createDataFrame(rows, "q string, c string, n long").withColumnRenamed("n", "s").repartition(7)
    got = top_n(df, "q", "c", "s", n, buckets=1 + n % 3).collect()
    assert sorted((x["q"], x["c"], x["s"], x["place"]) for x in got) == brute(rows, n)


def test_time_is_linear_in_the_batches():
    def took(k):
        batch = lambda b: pa.RecordBatch.from_pydict({"g": [f"{b}-{j}" for j in range(10_000)], "s": list(range(10_000)), "i": ["x"] * 10_000}, schema=pa.schema({"g": pa.string(), "s": pa.int64(), "i": pa.string()}))
        made = [batch(b) for b in range(k)]
        began = time.perf_counter()
        assert sum(len(b) for b in _best(5)(iter(made))) == 10_000 * k
        return time.perf_counter() - began

    took(5)
    assert took(200) < 8 * took(50)  # four times the rows; merging all again at every batch would take sixteen times as long


def test_empty(spark):
    df = spark.createDataFrame([], "g string, i string, s long")
    assert top_n(df, "g", "i", "s").collect() == []
    assert top_n(spark.createDataFrame([("a", "b", 1)], "g string, i string, s long"), "g", "i", "s", 0).collect() == []
