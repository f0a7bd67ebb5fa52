import pyarrow as pa
import pytest

from scriptorium.operators.packed import author_names, byline_authors, split_packed, split_strings

CASES = [
    ("Doe, J. and Roe, M.", ["Doe, J.", "Roe, M."]),
    ('["V O\'Neil", "B C"]', ["V O'Neil", "B C"]),
    ("['D Trorb', 'R Zas']", ["D Trorb", "R Zas"]),
    ('"Doe, A", "Roe, P."', ["Doe, A", "Roe, P."]),
    ('"A B","C D"', ["A B", "C D"]),
    (" A Tor, Y O''Boo,, S Rie ,J N, ,K The, ", ["A Tor", "Y O''Boo", "S Rie", "J N", "K The"]),
    ("E Kis / I Klon,C Ger", ["E Kis", "I Klon", "C Ger"]),
    ("Rieholm, Samuel;Pinnerka, J", ["Rieholm, Samuel", "Pinnerka, J"]),
    ("JN Ster; Emeka Jei; UT Gro and JL Ken, NR Bal", ["JN Ster", "Emeka Jei", "UT Gro", "JL Ken", "NR Bal"]),
    ("", []),
    (None, []),
    ("  ", []),
    ("WN Skil;ET Rorilla", ["WN Skil", "ET Rorilla"]),
    ("van der Treis, Sasha; Dron, H", ["van der Treis, Sasha", "Dron, H"]),
    ("Maipen Hinsk, MM", ["Maipen Hinsk, MM"]),
    ("R Zel, Ric…", ["R Zel", "Ric"]),
    ("A B, …", ["A B"]),
    ("A B...", ["A B"]),
    ("K....", ["K."]),
    ("Tri KO，VS Ste", ["Tri KO", "VS Ste"]),
    ("A B；C D、E F·G H", ["A B", "C D", "E F", "G H"]),
    ("Prar, D and Brin, P and Tried, K. O. and", ["Prar, D", "Brin, P", "Tried, K. O."]),
    ("A B and C D, and E F", ["A B", "C D", "E F"]),
    ("Sandra Land, B Andersen", ["Sandra Land", "B Andersen"]),
    ("G Kai\tTA Wil\nB Wal", ["G Kai", "TA Wil", "B Wal"]),
    ('["F C, ', ["F C"]),
    ("\xa0A B ; C D\xa0", ["A B", "C D"]),
    ("Pup-Sket, Isabella H.; Xu, Y", ["Pup-Sket, Isabella H.", "Xu, Y"]),
    ("Rieholm, Samuel, Pinnerka, J", ["Rieholm, Samuel", "Pinnerka, J"]),
    ("…tad, K Rie", ["tad", "K Rie"]),
    ("A B AND C D", ["A B", "C D"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert split_strings(pa.array([text], pa.string())).to_pylist() == [want]


def test_batch_equals_single_rows_and_slices():
    texts = [t for t, _ in CASES]
    whole = split_strings(pa.array(["pad", *texts, "pad"], pa.string()).slice(1, len(texts)))
    assert whole.to_pylist() == [w for _, w in CASES]
    assert split_strings(pa.array([], pa.string())).to_pylist() == []


def test_round_trip_of_joined_names():
    names = [f"{chr(65 + i % 26)} Name{chr(97 + i % 26)}x" for i in range(60)]
    for sep in ("; ", ";", "|", " | ", "/", ", ", ",", "\t", "；", " · ", " and "):
        assert split_strings(pa.array([sep.join(names)])).to_pylist() == [names], sep


def test_very_long_text():
    assert len(split_strings(pa.array(["A Bcd; " * 50_000])).to_pylist()[0]) == 50_000


def test_rows_positions_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "A B; C D", 9), (2, None, 8), (1, "A B; C D", 9)], "id int, names string, pos int")
    rows = sorted(map(tuple, split_packed(df, "names", keep=["id"]).collect()))
    assert rows == [(1, 1, "A B"), (1, 1, "A B"), (1, 2, "C D"), (1, 2, "C D")]
    assert split_packed(df.limit(0), "names", keep=["id"]).collect() == []


def test_byline(spark):
    texts = ["A B, C D - Reef Letters, 2019 - x.example", "A B | C D | 2010 | x.example", "A B | Reef | x.example", "A B — Reef, 1 — y", "A B, C D", "A B\xa0- Reef\xa0- z", None]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "obs_id int, authors string, byline string")
    got = [r[0] for r in df.select(byline_authors(df.byline).alias("a")).collect()]
    assert [g and g.strip() for g in got] == ["A B, C D", "A B | C D", "A B", "A B", "A B, C D", "A B", None]
    assert {tuple(r) for r in author_names(df).where("obs_id = 1").collect()} == {(1, 1, "A B"), (1, 2, "C D")}
