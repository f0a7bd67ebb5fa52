import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scriptorium import queries
from scriptorium.functions import biblio as bx
from scriptorium.functions import ids, urls
from scriptorium.functions import text as tx
from scriptorium.functions import venues as vx
from scriptorium.operators import audit, biblio, delta, filters, graph, planning, stale, summary
from scriptorium.operators.components import connected_components
from scriptorium.operators.merge import merge_richest
from scriptorium.sources import html, jsonl, sinks, stores

REC = "ord long, k string, title string, venue string, cited_by_count long, versions_count long, extra struct<follow_depth:long, bibtex_key:string, citation_id:string>"


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


def values(spark, f, texts, kind="string"):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], f"v {kind}").select(f(F.col("v"))).collect()]


# ---- merge


def fold(rows):
    """The left fold itself: later wins if richer, the loser fills."""
    has = lambda v: v is not None and v != ""
    acc = None
    for r in rows:
        if acc is None:
            acc = dict(r)
            continue
        rank = lambda d: (d["cited_by_count"] or -1, sum(has(d[f]) for f in ("title", "venue", "cited_by_count", "versions_count")))
        win, lose = (r, acc) if rank(r) > rank(acc) else (acc, r)
        acc = {f: win[f] if has(win[f]) else lose[f] for f in ("title", "venue", "cited_by_count", "versions_count")}
    return acc


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_against_the_fold(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice("abcde"), r.choice([None, "", "T1", "T2", "T3"]), r.choice([None, "", "V1", "V2"]), r.choice([None, 0, -1, -3, -7, *((1, 2, 5) if seed == 1 else (None, -2))]), r.choice([None, 0, 3, 4]), None) for i in range(200)]
    df = spark.createDataFrame(rows, REC)
    fields = ["title", "venue", "cited_by_count", "versions_count"]
    got = {x["k"]: x for x in merge_richest(df, "k", "ord", "cited_by_count", fields).collect()}
    for k in "abcde":
        want = fold([dict(zip(("title", "venue", "cited_by_count", "versions_count"), x[2:6], strict=True)) for x in rows if x[1] == k])
        assert {f: got[k][f] for f in fields} == {f: v if v != "" else None for f, v in want.items()}
        assert got[k]["n_rows"] == sum(x[1] == k for x in rows)


def test_merge_of_negative_counts_and_many_fields(spark):
    rows = [(1, "a", "T1", None, None, None, None), (2, "a", None, None, -5, None, None), (3, "a", "T3", None, -3, None, None)]
    one = merge_richest(spark.createDataFrame(rows, REC), "k", "ord", "cited_by_count", ["title", "venue", "cited_by_count"]).first()
    assert (one["title"], one["cited_by_count"]) == ("T3", -3)
    names = [f"f{i}" for i in range(130)]
    wide = spark.createDataFrame([(1, "a", 3, *["x"] * 100, *[None] * 30), (2, "a", 3, *[None] * 100, *["y"] * 30), (3, "a", 3, *["z"] * 130), (4, "a", 3, *["w"] * 130)], "ord int, k string, n int, " + ", ".join(f"{n} string" for n in names))
    got = merge_richest(wide, "k", "ord", "n", ["n", *names]).first()
    assert [got[n] for n in names] == ["x"] * 100 + ["y"] * 30  # the union is as rich as the later rows


def test_merge_extra_and_empty(spark):
    rows = [(1, "a", "T", None, 5, None, Row(follow_depth=2, bibtex_key=None, citation_id="c")), (2, "a", None, None, 9, None, Row(follow_depth=1, bibtex_key="key", citation_id=None)), (3, "b", "X", None, None, None, None)]
    df = spark.createDataFrame(rows, REC)
    got = {x["k"]: x for x in merge_richest(df, "k", "ord", "cited_by_count", ["title", "cited_by_count"], "extra").collect()}
    assert (got["a"]["title"], got["a"]["cited_by_count"]) == ("T", 9)
    assert tuple(got["a"]["extra"]) == (1, "key", "c")
    assert got["b"]["extra"] is None
    assert merge_richest(df.limit(0), "k", "ord", "cited_by_count", ["title"], "extra").collect() == []


# ---- scan


def test_lenient_lines(spark):
    lines = [
        '{"title": "A", "year": "2019", "cited_by_count": "7"}', "{oops", "[1, 2]", "   ", '{"title": "B", "year": "soon", "authors": ["J Smith", "K Lee"], "extra": "none"}',
        '{"year": true, "citation_only": "no"}', '{"year": 2019.0}', '{"year": " 12 ", "cited_by_count": "-7"}', '{"year": 2000, "year": 2001}', '{"title": "a b", "extra": {"follow_depth": null, "x": 1}}',
    ]
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    df = jsonl.parse_lines(spark.createDataFrame(list(enumerate(lines)), "ord int, value string"))
    got = {r["ord"]: r for r in df.collect()}
    assert 3 not in got and got[1]["malformed"] and got[2]["malformed"]
    assert (got[0]["year"], got[0]["cited_by_count"], got[0]["repaired"]) == (2019, 7, True)
    assert (got[4]["year"], got[4]["authors"], got[4]["extra"], got[4]["repaired"]) == (None, "J Smith, K Lee", None, True)
    assert (got[5]["year"], got[5]["citation_only"], got[5]["repaired"]) == (None, None, True)
    assert got[6]["year"] is None and (got[7]["year"], got[7]["cited_by_count"]) == (12, -7) and got[8]["year"] == 2001
    assert got[9]["title"] == "a b" and not got[9]["repaired"]
    assert tuple(jsonl.scan_counts(df).first()) == (7, 2, 5)


def test_files_in_order(spark, tmp_path):
    for name, n in (("b.jsonl", 2), ("a.jsonl", 3), ("c.txt", 1)):
        (tmp_path / name).write_text("\n".join(f'{{"title": "{name}{i}"}}' for i in range(n)) + "\n")
    found = jsonl.resolve_inputs(str(tmp_path), [str(tmp_path / "c.txt")], [])
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.jsonl", "b.jsonl", "c.txt"]
    got = [r[0] for r in jsonl.read_records(spark, found).orderBy("ord").select("title").collect()]
    assert got == ["a.jsonl0", "a.jsonl1", "a.jsonl2", "b.jsonl0", "b.jsonl1", "c.txt0"]
    with pytest.raises(ValueError, match="bad_inputs"):
        jsonl.resolve_inputs(None, [])


def test_many_files_and_equal_names(spark, tmp_path):
    paths = []
    for k in range(200):
        folder = tmp_path / f"d {k % 7}+{k}%"
        folder.mkdir()
        (folder / "same.jsonl").write_text("\n".join(f'{{"title": "{k}-{i}"}}' for i in range(2)) + "\n")
        paths.append(str(folder / "same.jsonl"))
    random.Random(2).shuffle(paths)
    want = [f"{p.rsplit('+', 1)[1].split('%')[0]}-{i}" for p in paths for i in range(2)]
    rows = jsonl.number_lines(jsonl.read_records(spark, paths)).orderBy("ord").select("ord", "title").collect()
    assert [r["title"] for r in rows] == want and [r["ord"] for r in rows] == list(range(400))


def test_target_lists(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# comment\n\n  b c \na\n")
    (tmp_path / "none.txt").write_text("# nothing\n\n")
    assert [r["value"] for r in jsonl.target_list(spark, ["a", "z"], str(tmp_path / "q.txt")).orderBy("ord").collect()] == ["a", "z", "b c", "a"]
    with pytest.raises(ValueError, match="names no target"):
        jsonl.target_list(spark, [], str(tmp_path / "none.txt"))


# ---- scalar functions


def test_venues(spark):
    rows = values(spark, vx.split_venue, ["nature 521 (7553), 436-444", "Reef Letters 12, 3, 2019", "… Journal of X and …", "2019", "", "   ", ",", "…", None, "X 3 ()"])
    assert [tuple(r) if r else None for r in rows[:4]] == [("nature", "521", "7553", "436-444", False, False), ("Reef Letters", "12", None, "3", False, False), ("Journal of X and", None, None, None, True, True), ("2019", None, None, None, False, False)]
    assert [r["name"] if r else None for r in rows[4:]] == ["", "", "", "", None, "X"]
    assert values(spark, vx.normalize_venue, ["arXiv preprint arXiv:1", "A and …", "…", "", "Nature 3 (2), 1-2"]) == ["arXiv preprint", "A and …", "…", "", "Nature"]
    assert values(spark, vx.venue_field, ["arXiv preprint arXiv …", "Trans on Data …", None]) == ["arXiv preprint", "Trans on Data ...", ""]


def test_text(spark):
    assert values(spark, lambda c: tx.clip(c, 5), ["abcde", "abcdef", "abc  xyz", None]) == ["abcde", "abcd…", "abc…", None]
    assert values(spark, tx.casefold, ["Straße İ ŉ ẞ", "ΑΣ", None]) == ["Straße İ ŉ ẞ".casefold(), "ασ", None]
    assert values(spark, tx.ascii_slug, ["Łódź Größe", "Veličković", "Ærø"]) == ["lodzgrosse", "velickovic", "aero"]
    assert values(spark, tx.all_ints, ["Page 2 of about 16,800 results", "none"]) == [[2, 16800], []]
    assert values(spark, tx.first_int, ["Cited by 1\xa0234", "x", None]) == [1234, None, None]
    b = values(spark, tx.split_byline, ["A Smith, B Lee - Nature, 2019 - nature.example", "A - arXiv preprint arXiv:1910.11945, 2019 - x", "", None])
    assert [tuple(x) for x in b] == [("A Smith, B Lee", "Nature", 2019), ("A", "arXiv preprint arXiv:1910.11945", 2019), (None, None, None), (None, None, None)]
    assert values(spark, tx.strip_year, ["2022-2023", "Nature, 2019,", "2019"]) == [None, "Nature", None]
    assert values(spark, tx.strip_tag, ["[PDF] A", "A [x]"]) == ["A", "A [x]"]


def test_ids_and_signatures(spark):
    assert values(spark, ids.parse_id, [" 123 ", "/scholar?cites=45&x", "a?cluster=6", "none", None]) == ["123", "45", "6", None, None]
    s = ["a|b|cites=|cluster=|lo=2020|hi=|lang=en|date=1|cit=0|pat=1|rev=0", "author=abcdefghijkl|lang=|year=1", "|cites=5|cluster=|lo=|hi=|lang=|date=0|cit=1|pat=1|rev=1", "junk", "|cites=|cluster=|lo=|hi=|lang=|date=0|cit=1|pat=1|rev=1", "q|cites=|cluster=|lo=x|hi=|lang=|date=0|cit=1|pat=1|rev=1"]
    got = values(spark, ids.parse_signature, s)
    assert got[0]["query"] == "a|b" and got[0]["year_low"] == 2020 and got[0]["sorted"] and not got[0]["citations"]
    assert got[1]["user_id"] == "abcdefghijkl" and got[2]["cites"] == "5" and got[3:] == [None, None, None]
    assert values(spark, ids.describe_signature, s[:4]) == ["a|b [en, 2020, by date, no citations]", "author:abcdefghijkl [by year]", "cites:5 [reviews only]", "junk"]


def test_urls(spark):
    got = values(spark, urls.redact_url, ["https://x.example/s?q=a+b&sig=1#f", "https://x.example/sorry/i?continue=9&hl=en", "https://x.example/s#f", None, "/s?q=%26&k"])
    assert got == ["https://x.example/s?q=a+b&sig=REDACTED", "https://x.example/sorry/i?continue=REDACTED&hl=en", "https://x.example/s#f", None, "/s?q=%26&k=REDACTED"]
    assert values(spark, lambda c: urls.absolute(c, F.lit("https://h")), ["/a", "a", "//b/c", "http://d", "", None]) == ["https://h/a", "https://h/a", "https://b/c", "http://d", None, None]
    assert values(spark, urls.quote, ["a b~*ü"]) == ["a+b~%2A%C3%BC"]


# ---- audit, delta, graph, stale, planning


FULL = "obs_id long, cluster_id string, title string, link string, byline string, authors string, venue string, year long, cited_by_count long, cited_by_url string, versions_count long, versions_url string, citation_only boolean, query string, fetched_at string, extra struct<follow_depth:long, bibtex_key:string, citation_id:string>"


def record(i, **kw):
    base = {"obs_id": i, "cluster_id": f"c{i}", "title": f"T{i}", "link": "l", "byline": "A B - X, 2020", "authors": "A B", "venue": "X", "year": 2020, "cited_by_count": 10, "cited_by_url": "/s?cites=1", "versions_count": 2, "versions_url": None, "citation_only": False, "query": "q", "fetched_at": "2026-01-01T00:00:00", "extra": None}
    return tuple((base | kw).values())


def test_audit_batch_and_examples(spark):
    rows = [record(1), record(2, title="", year=1700), record(3, venue="10 (2), 5", authors="A …", cited_by_count=-1), record(4, byline="A - X, 2019 - y", cluster_id=None), record(5, title=None, venue=None, year=None, authors=None, cited_by_url=None)]
    df = spark.createDataFrame(rows, FULL)
    got = {r["check"]: r["count"] for r in audit.audit_counts(df, audit.checks(2026)).collect()}
    assert got == {
        "title_missing": 2, "year_out_of_range": 1, "year_disagrees_with_byline": 2, "venue_looks_like_pages": 1, "citations_without_link": 1, "negative_count": 1, "year_missing": 1, "venue_missing": 1, "authors_missing": 1, "authors_truncated": 1, "cluster_id_missing": 1,
    }
    first = audit.audit_counts(df, audit.checks(2026)).first()
    assert first["severity"] == "error" and first["count"] == 2
    assert audit.audit_counts(df.limit(0), audit.checks(2026)).collect() == []
    ex = audit.audit_examples(df, audit.checks(2026), "obs_id", 1).where("check = 'title_missing'").first()
    assert (ex["value"], ex["title"]) == ("<empty>", "<empty>")


def test_delta_is_asymmetric_about_nulls(spark):
    side = lambda rows: delta.last_rows(spark.createDataFrame(rows, "k string, l string, n long, o int"), F.col("k"), F.col("l"), F.col("n"), "o")
    before = side([("a", "A", None, 1), ("b", "B", 30, 1), ("c", "C", None, 1), ("d", "D", 1, 1), ("d", "D", 5, 2), ("old", "Same", 1, 1)])
    after = side([("a", "A", 30, 1), ("b", "B", None, 1), ("c", "C", 0, 1), ("d", "D", 5, 1), ("new", "Same", 1, 1)])
    got = {r["key"]: (r["status"], r["change"]) for r in delta.compare(before, after).collect()}
    assert got == {"a": ("moved", 30), "b": ("same", None), "c": ("moved", 0), "d": ("same", None), "old": ("gone", None), "new": ("added", None)}
    assert [r[0] for r in delta.reclustered(delta.compare(before, after)).collect()] == ["Same"]


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(120)}", f"n{r.randrange(120)}") for _ in range(90)] + [("x", "x"), (None, "y"), ("hub", "n1")] + [("hub", f"leaf{i}") for i in range(50)]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        if a and b and a != b:
            up[find(a)] = find(b)
    want = {}
    for n in list(up):
        want.setdefault(find(n), set()).add(n)
    got = {}
    for row in connected_components(spark.createDataFrame(edges, "a string, b string")).collect():
        got.setdefault(row["component"], set()).add(row["node"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and all(min(v) == k for k, v in got.items())
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_graph_stubs_and_walk(spark):
    rows = [record(1, cited_by_url="/s?cites=100", cited_by_count=50), record(2, query="cites:100", cited_by_url="/s?cites=200", cited_by_count=20), record(3, query="cites:100", cited_by_url="/s?cites=300", cited_by_count=5), record(4, query="cites:200", cited_by_url=None), record(5, query="cites:999", cited_by_url=None)]
    df = spark.createDataFrame(rows, FULL)
    e = {(r["citing"], r["cited"], r["stub"]) for r in graph.build_edges(df, df, "obs_id").collect()}
    assert e == {("c2", "c1", False), ("c3", "c1", False), ("c4", "c2", False), ("c5", "cites:999", True)}
    walk = [tuple(r) for r in graph.follow(df.where("obs_id = 1"), df, 3, 1).orderBy("level").collect()]
    assert walk == [("100", 50, 1), ("200", 20, 2)]
    counts = graph.network_summary(graph.nodes_of(df, "obs_id"), graph.build_edges(df, df, "obs_id")).first()
    assert (counts["edges"], counts["components"], counts["largest"], counts["isolated"], counts["uncollected"]) == (4, 2, 4, 0, 1)


def test_component_order_and_texts(spark):
    edges = spark.createDataFrame([("b", "a", False, 3), ("d", "c", False, 2), ("e", "c", False, 9), ("g", "f", False, 1)], "citing string, cited string, stub boolean, first long")
    nodes = spark.createDataFrame([(k, i) for i, k in enumerate("gfedcbah")], "key string, first long")
    assert [tuple(x) for x in graph.component_sizes(nodes, edges).collect()] == [("c", 3, "e"), ("f", 2, "g"), ("a", 2, "b"), ("h", 1, "h")]
    t = spark.createDataFrame([("listing",), ("author",)], "kind string")
    b = planning.Budget(pages=3, depth=1, breadth=4, bibtex=True)
    lines = [x["line"] for x in planning.plan_text(planning.plan_cost(t, b), b).orderBy("k").collect()]
    assert lines[0] == "seed targets: 6 page loads, up to 330 records" and lines[1] == "citation expansion: up to 8 listings, 24 page loads, up to 240 records"
    assert lines[-1] == "estimated 8.0 h at 4–11s between requests plus 147 cooldowns of 90s"
    assert planning.budget_concerns(planning.Budget()) == [] and [x[0] for x in planning.budget_concerns(planning.Budget(min_delay=1, max_results=5, cooldown_every=0), blocks_ignored=2)] == ["warn", "warn", "warn", "note"]
    assert planning.cursor_concerns(True, 0, 0)[0][0] == "warn" and planning.cursor_concerns(True, 10, 2) and not planning.cursor_concerns(True, 0, 2)
    loads = spark.createDataFrame([(0, 0), (60, 2), (120, 0)], "at long, retries long")
    ev = spark.createDataFrame([("captcha", "solved", "x"), ("captcha", "rehearsed", "x")], "kind string, outcome string, target string")
    s = planning.run_statistics(loads, ev).first()
    assert (s["requests"], s["retries"], s["elapsed"], s["per_minute"], s["takeovers"], s["kinds"]) == (3, 2, 120.0, 1.5, 1, {"captcha": 1})
    sig = ["it's|cites=|cluster=|lo=2020|hi=|lang=|date=1|cit=1|pat=1|rev=0", "author=abcdefghijkl|lang=de|year=1", "junk"]
    assert values(spark, lambda c: planning.resume_text(c, "collect"), sig) == ["collect --query 'it'\"'\"'s' --year-from '2020' --by-date --resume", "collect --author 'abcdefghijkl' --lang 'de' --by-date --resume", None]


def test_stale(spark):
    rows = [record(1, fetched_at="2026-01-01T00:00:00", cited_by_count=99, versions_url="/s?cluster=7"), record(2, fetched_at="2026-08-31T00:00:00"), record(3, fetched_at="soon"), record(4, fetched_at="2026-01-01T00:00:00+00:00", cited_by_count=None, versions_url="/s?cluster=7")]
    df, now = spark.createDataFrame(rows, FULL), F.lit("2026-09-01T00:00:00").cast("timestamp")
    ranked = stale.rank_stale(df, now, 30)
    assert [(r["obs_id"], r["age_days"], round(r["pressure"], 6)) for r in ranked.collect()] == [(1, 243.0, 486.0), (4, 243.0, 0.0)]
    assert [r["target"] for r in stale.refresh_targets(ranked).collect()] == ["7"] and stale.refresh_targets(ranked, 0).collect() == []
    lines = ranked.select("obs_id", stale.described().alias("line")).collect()
    assert lines[0]["line"] == "  243d         99 citations  cluster 7                     T1" and "          ? citations" in lines[1]["line"]
    assert [x["line"] for x in stale.refresh_lines(ranked, 5, "obs_id").orderBy("o").collect()][1] == "# 243 days old: T1\n7"
    s = stale.stale_stats(df, now).first()
    assert (s["undated"], s["stale"], s["refreshable"], s["youngest"]) == (1, 2, 2, 1.0)


def test_planning(spark):
    t = spark.createDataFrame([("listing",), ("listing",)], "kind string")
    p = planning.plan_cost(t, planning.Budget(pages=3, depth=1, breadth=4, bibtex=True)).first()
    assert (p["total_loads"], p["total_records"], p["cooldowns"]) == (630, 300, 63)
    assert planning.plan_cost(t.limit(1), planning.Budget(depth=2, breadth=5)).first()["follow_listings"] == 30
    for blocks, close, early, want in ((1, 5, 1, 1.0), (2, 0, 99, 1.3), (5, 1, 30, 2.0), (4, 1, 31, 1.5)):
        assert round(one(spark, planning.pace_factor(F.lit(blocks), F.lit(close), F.lit(early))), 6) == want
    assert planning.pages_needed(5, 25, 10) == 3 and planning.pages_needed(5, 0, 10) == 1


def test_filters_and_groups(spark):
    df = spark.createDataFrame([record(1, year=None), record(2, cited_by_count=-1), record(3, venue="NATURE 3 (1)", cited_by_count=0, year=0), record(4, venue="Nature"), record(5, venue="Nature", citation_only=True, extra=Row(follow_depth=2, bibtex_key="k", citation_id=None))], FULL)
    assert sorted(r["obs_id"] for r in filters.filter_records(df).collect()) == [1, 3, 4, 5]
    assert sorted(r["obs_id"] for r in filters.filter_records(df, 0, 2000).collect()) == [4, 5]
    g = {r["label"]: tuple(r)[1:6] for r in summary.group_profile(df, summary.group_label("venue"), "obs_id").collect()}
    assert g == {"X": (2, 9, 4, 2020, 2020), "NATURE": (2, 10, 5, 2020, 2020)}
    o = summary.overview(df).first()
    assert (o["records"], o["with_bibtex"], o["citation_only"], o["unknown_year"], o["venue_count"], o["author_count"]) == (5, 1, 1, 2, 2, 1)
    with pytest.raises(ValueError, match="unknown group key"):
        summary.group_label("colour")


def test_bibliography(spark):
    df = spark.createDataFrame([record(1, title="On the C*-algebras & {x}", authors="P Veličković, …", venue="Proceedings of X 3 (1), 5-6"), record(2, title="  "), record(3, title="The C* way", authors="P Veličković"), record(4, title="C* again", authors="P Veličković", extra=Row(follow_depth=0, bibtex_key="velickovic2020ca", citation_id=None)), record(5, title="C*", authors="P Veličković")], FULL)
    got = {r["obs_id"]: r for r in biblio.bibliography(df, "obs_id", "the site").collect()}
    assert sorted(got) == [1, 3, 4, 5]
    assert [got[i]["key"] for i in (1, 3, 4, 5)] == ["velickovic2020c", "velickovic2020ca", "velickovic2020caa", "velickovic2020cb"]
    text = got[1]["entry"]
    assert text.startswith("@inproceedings{velickovic2020c,\n  title = {{On the C*-algebras \\& (x)}},\n  author = {P Veličković and others},\n  booktitle = {Proceedings of X},\n  volume = {3},\n  number = {1},\n  pages = {5-6},\n  year = {2020},")
    assert tuple(biblio.bibliography_report(df).first()) == (4, 1, 1, 1)
    assert values(spark, bx.bibtex_key, ["@article{key1,\n x}", "junk"]) == ["key1", None]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_citation_keys_one_by_one(spark, seed):
    r = random.Random(seed)
    bases = {1: ["x", "xa", "xab", "xaba", "y"], 2: ["k", "ka", "kb", "kba", "kc", "kbac", "z{", "z"], 3: ["a", "ab", "abc", "abcd", "b"]}[seed]
    rows = [(i, r.choice(bases)) for i in range(120)]
    if seed == 1:
        rows = [(0, "x"), (1, "xa"), (2, "xa"), (3, "xa"), (4, "xab")] + [(i + 5, b) for i, b in rows]
    used, want = set(), {}
    for i, b in rows:
        k, n = b, 0
        while k in used:
            n += 1
            k = b + chr(96 + n)
        used.add(k)
        want[i] = k
    df = spark.createDataFrame(r.sample(rows, len(rows)), "o long, b string")
    got = {x["o"]: x["key"] for x in biblio.unique_keys(df, "b", "o").collect()}
    assert got == want


def test_citation_keys_of_many_rows(spark):
    """More rows of a base than letters before the halves of pairs (55,199), and more than fit two bytes (63,391); bases that want letters there."""
    letters = [chr(i) for i in range(97, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    bases = ["x\ud7ff", "x\ue000", "x\ue002", "x\ufeff", "x\uffff", "x\U00010000", "x\U0001f600"]
    rows = [(i, "x") for i in range(70_000)]
    rows += [(100_000 + i, b) for i, b in enumerate(bases[1::2])] + [(-9 + i, b) for i, b in enumerate(bases[::2])]
    used, at, want = set(), {}, {}
    for i, b in sorted(rows):
        k = b
        while k in used:
            at[b] = at.get(b, -1) + 1
            k = b + letters[at[b]]
        used.add(k)
        want[i] = k
    df = spark.createDataFrame(rows, "o long, b string")
    got = {x["o"]: x["key"] for x in biblio.unique_keys(df, "b", "o").collect()}
    assert got == want and want[55_200] == "x\ue001" and "x\U00010001" in used


def test_key_suffix_of_every_number(spark):
    n = spark.range(0, 2 * bx.LETTERS + 3).select("id", bx.key_suffix(F.col("id")).alias("s"))
    assert n.where(bx.suffix_number(F.col("s")) != F.col("id")).count() == 0 and n.agg(F.count_distinct("s")).first()[0] == 2 * bx.LETTERS + 3
    last = chr(0x10FFFF)
    some = {0: "", 1: "a", 55_199: "\ud7ff", 55_200: "\ue000", bx.LETTERS: last, bx.LETTERS + 1: last + "a", 2 * bx.LETTERS + 1: 2 * last + "a"}
    assert {r["id"]: r["s"] for r in n.where(F.col("id").isin(*some)).collect()} == some


def test_key_suffix_query_of_many_rows(spark, tmp_path):
    """60,000 orders of one base: their ranks, as the SQL of the query has them."""
    o = spark.range(60_000).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("1995-01-01 00:00:00").cast("timestamp").alias("o_orderdate"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.QUERIES["key_suffix"](spark, str(tmp_path))
    assert got.count() == 60_000 and got.where("base <> 'urgent1995' or n <> o_orderkey").count() == 0


def test_appended_entries_and_stored_ones(spark):
    e = spark.createDataFrame([(1, "@article{a,\n t}"), (2, "@article{b,\n u} "), (3, "@article{b,\n v}"), (4, "no key"), (5, "no key")], "o long, entry string")
    have = spark.createDataFrame([("@misc{a,\n x}",), (None,)], "entry string")
    assert sorted((x["o"], x["entry"]) for x in biblio.new_entries(e, have, "o").collect()) == [(2, "@article{b,\n u}"), (4, "no key"), (5, "no key")]
    rec = spark.createDataFrame([record(1, extra=Row(follow_depth=0, bibtex_key="b", citation_id=None)), record(2)], FULL)
    assert {x["obs_id"]: x["entry"] for x in biblio.with_entries(rec, e).collect()} == {1: "@article{b,\n u} ", 2: None}
    assert values(spark, stores.bibliography_keys, ["@article{k1,\n a}\n\n@misc{ k2 ,\n b}\ntext @x{no,"]) == [["k1", "k2"]]


def test_pages_of_any_depth(spark):
    deep = "<p>" * 5_000 + "<div>" * 5_000 + '<div class="gs_r gs_or gs_scl" data-cid="z"><h3 class="gs_rt">Deep <ul><li>one<li>two</ul></h3></div>'
    df = spark.createDataFrame([(1, deep)], "page_id int, html string")
    assert [(x["cluster_id"], x["title"]) for x in html.result_cards(df, F.lit("https://h")).collect()] == [("z", "Deep onetwo")]
    root = html.parse_html("<div><p>a<p>b<div>c</div></div><ul><li>x<ul><li>y</ul><li>z</ul>")
    assert [n.text() for n in root.find("p")] == ["a", "b"] and [len(list(n.walk())) for n in root.find("li")] == [2, 0, 0]
    html.register_page_functions(spark)
    spark.createDataFrame([(1, deep)], "page_id int, html string").createOrReplaceTempView("saved")
    assert [tuple(x) for x in spark.sql("select cluster_id, title from saved, lateral page_cards(html)").collect()] == [("z", "Deep onetwo")]


def test_html(spark):
    page = """<div class="gs_ab_mdw">Page 2 of about 1,240 results</div>
    <div class="gs_r gs_or gs_scl" data-cid="abc"><div class="gs_ggs gs_fl"><div class="gs_ggsd"><div class="gs_or_ggsm"><a href="//p.example/x.pdf"><span class="gs_ctg2">[PDF]</span> p</a></div></div></div>
      <h3 class="gs_rt"><span>[PDF]</span><a href="https://x.example/a">multi-<b>agents</b> &amp; more</a></h3><div class="gs_a">A Smith - Nature, 2019 - x.example</div><div class="gs_rs">Some<br>text</div>
      <div class="gs_fl"><a href="/scholar?cites=12&amp;hl=en">Cited by 1,234</a><a href="/scholar?cluster=13&amp;cites=1">All 5 versions</a><a href="/scholar?q=related:x">Related</a></div></div>
    <div class="gs_r gs_or gs_scl"><h3 class="gs_rt">[CITATION] Lost work</h3></div><a href="/scholar?start=20&amp;q=x">next</a>"""
    df = spark.createDataFrame([(1, page, 10), (2, None, 0)], "page_id int, html string, start int")
    a, b = html.result_cards(df, F.lit("https://h"), start="start").orderBy("position").collect()
    assert (a["title"], a["link"], a["position"], a["cited_by_count"], a["versions_count"], a["resource_link"], a["resource_type"], a["year"], a["venue"]) == ("multi-agents & more", "https://x.example/a", 11, 1234, 5, "https://p.example/x.pdf", "PDF", 2019, "Nature")
    assert (b["title"], b["citation_only"], b["position"], b["authors"]) == ("Lost work", True, 12, None)
    facts = html.page_facts(df.where("page_id = 1"), start="start").first()
    assert (facts["total_estimate"], facts["has_next"]) == (1240, True)


def test_stores(spark):
    ev = spark.createDataFrame([(1, '{"at": "t", "kind": "captcha", "waited": 3.25, "consecutive": 2, "saw": ["a", null]}'), (2, "nope"), (3, '{"outcome": "rehearsed", "saw": "xyz"}'), (4, "")], "ord int, value string")
    got = stores.parse_events(ev).collect()
    assert len(got) == 3 and got[0]["waited"] == 3.25 and got[0]["saw"] == ["a", "?"] and got[1]["unreadable"] and got[2]["saw"] == []
    st = spark.createDataFrame([('{"s1": {"next_start": "20", "exhausted": true, "updated_at": "x"}, "s2": 5}',)], "value string")
    rows = {r["signature"]: r for r in stores.parse_cursors(st).collect()}
    assert rows["s1"]["next_start"] == 20 and rows["s1"]["repaired"] and rows["s2"]["dropped"]
    with pytest.raises(Exception, match="state_unreadable"):
        stores.parse_cursors(spark.createDataFrame([("[1]",)], "value string")).collect()
    assert sinks.collisions({"a": "/tmp/x", "b": "/tmp/x", "c": "/tmp/y"}) == [("a", "b")]
