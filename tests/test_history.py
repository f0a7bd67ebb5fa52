import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.times import iso_seconds
from scriptorium.operators.history import counted, scd2_history, scd2_merge

SCHEMA = "k string, t long, a long, b long, attr_hash string, valid_from int"


def brute(rows):
    by = {}
    for k, t, a, b, *_ in rows:
        if k is not None and t is not None:
            p = by.setdefault(k, {}).setdefault(t, [None, None])
            for i, v in enumerate((a, b)):
                if v is not None and v >= 0:
                    p[i] = v if p[i] is None else max(p[i], v)
    out = []
    for k, points in by.items():
        state, first, opened = (None, None), True, []
        for t in sorted(points):
            new = tuple(n if n is not None else o for n, o in zip(points[t], state, strict=True))
            if first or new != state:
                opened.append((t, new))
            state, first = new, False
        for i, (t, s) in enumerate(opened):
            end = opened[i + 1][0] if i + 1 < len(opened) else None
            out.append((k, t, end, *s, end is None))
    return sorted(out)


def rows_of(n, seed):
    r = random.Random(seed)
    v = lambda: r.choice([None, -1, 0, 1, 2, 2, 3])
    return [(r.choice([None, "a", "b", "hot", "hot", "hot"]), r.choice([None, *range(40)]), v(), v(), "x", 5) for _ in range(n)]


def attrs():
    return {"a": counted("a"), "b": counted("b")}


def rows_in_order(history):
    return sorted(map(tuple, history.drop("attr_hash", "seen_until").collect()), key=lambda x: (x[0], x[1]))


@pytest.mark.parametrize(("seed", "width", "period"), [(1, 7, 15), (2, 3, 1_000), (3, 1_000, 9)])
def test_history_against_brute_force(spark, seed, width, period):
    rows = rows_of(160, seed)
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    # rows of one instant need not agree here; the greatest value holds
    assert rows_in_order(scd2_history(df, "k", F.col("t"), attrs(), width, period)) == brute(rows)


def test_merge_in_order(spark):
    rows = [r for r in rows_of(120, 5) if r[0] and r[1] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    old = scd2_history(df.where("t < 20"), "k", F.col("t"), attrs(), 7, 15)
    assert rows_in_order(scd2_merge(old, df.where("t >= 20"), "k", F.col("t"), attrs(), slice_seconds=7)) == brute(rows)


def test_merge_of_late_updates(spark):
    rows = [r for r in rows_of(150, 6) if r[0] and r[1] is not None]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + SCHEMA)
    first, then = df.where("n < 80"), df.where("n >= 80")
    old = scd2_history(first, "k", F.col("t"), attrs(), 7, 15)
    assert rows_in_order(scd2_merge(old, then, "k", F.col("t"), attrs(), first, 7, 15)) == brute(rows)
    with pytest.raises(ValueError, match="observations"):
        scd2_merge(old, then, "k", F.col("t"), attrs())
    # a value carried on is not one observed
    obs = [("x", 1, 1, 1, "", 0), ("x", 3, None, 2, "", 0)]
    o, late = spark.createDataFrame(obs, SCHEMA), spark.createDataFrame([("x", 2, 9, None, "", 0)], SCHEMA)
    got = rows_in_order(scd2_merge(scd2_history(o, "k", F.col("t"), attrs()), late, "k", F.col("t"), attrs(), o))
    assert got == [("x", 1, 2, 1, 1, False), ("x", 2, 3, 9, 1, False), ("x", 3, None, 9, 2, True)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert scd2_history(df, "k", F.col("t"), attrs()).collect() == []


def test_iso_notations(spark):
    texts = {
        "2024-01-12T10:00:50+00:00": 1705053650, "2024-01-12T15:30:50+05:30": 1705053650, "2024-01-12T10:00:50Z": 1705053650, "2024-01-12 10:00:50": 1705053650, "2024-01-12T06:30:50-03:30": 1705053650,
        "2024-01-12": 1705017600, "n/a": None, "": None, None: None, "2025-13-41T99:00:00": None, "2026": None, "20260902T122623": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(iso_seconds(df.t)).collect()] == list(texts.values())
