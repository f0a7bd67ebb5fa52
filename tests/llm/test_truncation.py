import random

from pyspark.sql import functions as F

from scriptorium.llm.truncation import Field, cut_values, truncation_report


def sentences(r, n):
    words = "reef plot basin index margin coarse stable signal archive survey counted sampled".split()
    return " ".join(" ".join(r.choice(words) for _ in range(r.randrange(5, 12))).capitalize() + "." for _ in range(n))


def test_limits_marks_and_broken_ends(spark):
    r = random.Random(4)
    rows, cut = [], set()
    for i in range(600):
        source = ["cut.example", "whole.example"][i % 2]
        text = sentences(r, r.randrange(1, 5))
        if source == "cut.example" and len(text) > 100:
            text = text[:100]
            if text[-1] != ".":
                cut.add(i)
        rows.append((i, f"http://{source}/{i}", text))
    extra = ["… the plot was counted.", "The plot was counted …", "The plot ... was counted.", "Available at https://x.example/912", "The plot was cou�", "The plot was &am", "The plot was <b", "The plot was co <i>the", "(See section 4).", "The plot was", "", " ", None]
    for k, t in enumerate(extra):
        rows.append((1000 + k, None, t))
    cut |= {1000, 1001, 1004, 1005, 1006, 1007, 1009}
    df = spark.createDataFrame([(*x, "clash") for x in rows], "obs_id int, link string, snippet string, field string")
    fields = (Field("snippet", sentences=True),)
    source = F.regexp_extract("link", "//([^/]+)", 1)
    found = cut_values(df, source=source, fields=fields)
    got = {x["obs_id"]: x["way"] for x in found.where("way is not null").collect()}
    assert set(got) == cut and found.where("(cut_begin or cut_end) <> (way is not null)").count() == 0
    assert {got[k] for k in cut if k < 1000} == {"limit"}  # unmarked values of the source with a limit come by its spike
    assert [got[1000 + k] for k in (0, 1, 4, 5, 6, 7, 9)] == ["mark", "mark", "torn", "torn", "torn", "torn", "unended"]
    report = {x["source"]: x for x in truncation_report(df, source=source, fields=fields).collect()}
    assert report["cut.example"]["limits"] == [100] and report["whole.example"]["n_cut"] == 0
    assert report["cut.example"]["n_limit"] == report["cut.example"]["n_cut"] > 50
    assert cut_values(df.limit(0), source=source, fields=fields).collect() == []


def test_names_cut_at_a_limit_but_not_whole_ones(spark):
    words = [f"{a}{b}ology" for a in "abcdefghij" for b in "klmnopqrst"]
    whole = [f"Annals of {w}" for w in words] + [f"Journal of {a} and {b}" for a, b in zip(words, reversed(words), strict=True)]
    rows = [(f"http://a{k}.example", v) for k in range(3) for v in whole] + [("http://cut.example", v[:20]) for v in whole]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "obs_id int, link string, venue string")
    got = cut_values(df, source=F.col("link"), fields=(Field("venue"),)).where("cut_end").collect()
    assert {x["source"] for x in got} == {"http://cut.example"} and {x["value"] for x in got} == {v[:20] for v in whole if len(v) > 20}
