from scriptorium.llm.survivorship import disputed_survivors, survivor_records, survivors

SCHEMA = "obs_id long, cluster_id string, title string, link string, year long, cited_by_count long, versions_count long, fetched_at string, value string, field string, citation_only boolean"


def test_survivors(spark):
    full, t = "On the coarse plot in reef optics", "2024-01-0{}T00:00:00Z"
    rows = [
        (9, "a", "[PDF] " + full, None, 2020, 5, -1, t.format(1)), (8, "a", full, "l", None, 7, None, t.format(3)), (7, "a", full, "l", 2020, -1, 3, t.format(4)),
        (6, "a", "On the coarse plot in re", None, None, 7, 2, "last week"), (5, "a", full.upper(), None, 2020, 6, None, t.format(2)), (4, "a", "", None, None, None, None, None), (3, "a", None, None, None, 9, None, "unknown"),
        (2, "b", "Same title", "x", 1, 1, 1, t.format(1)), (1, "b", "Same title", "x", 1, 1, 1, t.format(1)), (11, None, "T", None, None, 1, 1, t.format(1)),
        (20, "c", "A title that was c", None, None, None, None, None), (21, "c", "[HTML] A title that was cut somewhere", None, None, None, None, None),
        (30, "d", None, None, None, -5, None, t.format(1)), (31, "d", None, None, None, 4, None, "n/a"),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash", None) for r in rows], SCHEMA)
    got = {(r["cluster_id"], r["field"]): r["obs_id"] for r in disputed_survivors(df).collect()}
    # title: undamaged; link, year: not null; counts: latest dated row that has one, then its smallest holder
    assert got == {("a", "title"): 7, ("a", "link"): 7, ("a", "year"): 5, ("a", "cited_by_count"): 6, ("a", "versions_count"): 7}
    one = survivor_records(df).where("cluster_id = 'a'").first()
    assert (one["title"], one["link"], one["year"], one["cited_by_count"], one["versions_count"]) == (full, "l", 2020, 7, 3)
    assert survivors(df.limit(0)).collect() == []
    twice = {(r["cluster_id"], r["field"]): r["obs_id"] for r in disputed_survivors(df.union(df)).collect()}
    assert twice == got


def test_priority_then_time(spark):
    rows = [(1, "a", "T", "old", None, None, None, "2024-01-01T00:00:00Z", "", "", False), (2, "a", "T", "new", None, None, None, "2024-01-02T00:00:00Z", "", "", False), (3, "a", "T", "cited", None, None, None, "2024-01-03T00:00:00Z", "", "", True), (4, "a", "T", "undated", None, None, None, None, "", "", False)]
    got = disputed_survivors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["field"], r["value"], r["obs_id"]) for r in got] == [("link", "new", 2)]
