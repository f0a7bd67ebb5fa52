import random

import pytest

from scriptorium.llm.names import edits
from scriptorium.llm.venues import VenueList, VenueTrie, WordTrie, map_venues, venue_candidates

LIST = [
    (1, "Annals of Reef Optics", None, "Kloss Verlag"), (2, "International Workshop on Orchard Statistics", "IWOSOI", "Nerd Society"), (3, "Reef Anatomy Letters", None, None), (4, "Reef Anatomy Letters: Methods", None, None),
    (5, "European Journal of Harbour Aerodynamics and Bibliometrics", None, None), (6, "Proceedings of the International Conference on Drift Robotics", None, None), (7, "Slateserver", None, "Maus Editions"), (9, "Drift Forecasting Letters", None, None), (8, "Pebble Nutrition and Inference Quarterly", "PNIQ", None),
]
CASES = {
    "annals of reef optics 12 (3), 1-9": 1, "Ann. Reef Opt.": 1, "Anals of Reef Optics": 1, "Annals of Reef Opitcs": 1, "Kloss Verlag, Annals of Reef Optics 3": 1, "Annals of Reef Optics, Kloss Verlag 110 (1), 242-706": 1, "The Annals of Reef Optics.": 1, '"Annals of Reef Optics"': 1,
    "Int Wksp Orchard Statist, 2010": 2, "IWOSOI, 313-938": 2, "IWOSOI '08": 2, "23rd International Workshop on Orchard Statistics": 2, "International-Workshop on Orchard Statistics": 2, "International Workshop on Orch…": 2, "Intl. Workshop on Orchard Statistics": 2, "Intemational Workshop on Orchard Statistics": 2,
    "Reef Anatomy Letters 3": 3, "REEF ANATOMY LETTERS: METHODS": 4, "…Anatomy Letters: Methods": 4, "European Journal of Harbour Aero": 5, "… Harbour Aerodynamics and …": 5, "Eur. J. Harb. Aer. Bibl., vol. 24, no. 6": 5, "International Conference on Drift R0botics": 6, "Slateserver preprint Slateserver:1987.75934": 7, "Pebble Nutrition Infer Q 136": 8,
    "Drift For. Lett. 100 (8)": 9, "Drift For Lett": 9, "Annals of Dune Optics": 0, "PhD thesis": 0, "10 (2), 72-436": 0, "-": 0, "x.example": 0, "Reef Anatomy Letters and Notes": 0, "International Annals of Reef Optics": 0, "…": 0,
}


@pytest.mark.parametrize("value", list(CASES))
def test_cases(value):
    assert VenueTrie(LIST).match(value) == CASES[value]


def test_automaton_against_edit_distance():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 7)))
    words = {word() for _ in range(80)}
    trie = WordTrie(words)
    for _ in range(150):
        w = word()
        for most in (0, 1, 2):
            got = {}
            for x, d in trie.within(w, most):
                got[x] = min(d, got.get(x, 9))
            assert got == {x: edits(w, x, most) for x in words if edits(w, x, most) <= most}


def test_records(spark):
    rows = [(i, v, 99) for i, v in enumerate([*CASES, "Annals of Reef Optics", None, "  ", "Ann. Reef Opt."])]
    listed = spark.createDataFrame(LIST, "venue_id long, name string, acronym string, publisher string")
    got = {r["obs_id"]: r["venue_id"] for r in map_venues(spark.createDataFrame(rows, "obs_id int, venue string, venue_id int"), listed).collect()}
    n = len(CASES)
    assert got == {i: k for i, k in enumerate(CASES.values())} | {n + 3: 1}
    more = map_venues(spark.createDataFrame(rows, "obs_id int, venue string, venue_id int"), listed, shard_entries=2)  # five shards
    assert {r["obs_id"]: r["venue_id"] for r in more.collect()} == got
    assert map_venues(spark.createDataFrame([], "obs_id int, venue string"), listed).collect() == []
    none = map_venues(spark.createDataFrame([(1, "x y")], "obs_id int, venue string"), listed.limit(0)).collect()
    assert [tuple(r) for r in none] == [(1, "x y", 0)]


def test_all_entries_within_the_distance(spark):
    entries = [(5, "Journal of Marine Ecology", None, None), (3, "Annals of Marine Ecology", "AME", None), (4, "Annals of Marine Ecology!", "ame", None), (6, "Annals of Marine Geology", None, None)]
    ids = lambda v, e=entries: [i for *_, i in VenueTrie(e).matches(v)]
    assert ids("… Marine Ecology") == [3, 4, 5] and ids("Annals of Marine Ecology 3") == [3, 4] and ids("AME") == [3, 4]
    assert ids("Annals of Marine…") == [3, 4, 6] and ids("Nothing of the Kind") == []
    parts = [VenueTrie(entries[:2], VenueList(entries)), VenueTrie(entries[2:], VenueList(entries))]
    for v in ("… Marine Ecology", "Annals of Marine…", "Ann. Mar. Ecol.", "Anals of Marine Ecology"):
        both = sorted(x for t in parts for x in t.matches(v))
        assert [x for x in both if x[0] == both[0][0]] == VenueTrie(entries).matches(v)
    listed = spark.createDataFrame(entries, "venue_id long, name string, acronym string, publisher string")
    typed = spark.createDataFrame([(1, "… Marine Ecology"), (2, "… Marine Ecology"), (3, None), (4, "Annals of Marine Geology")], "obs_id int, venue string")
    for n in (1, 10):
        assert sorted(r["venue_id"] for r in venue_candidates(typed, listed, n).collect()) == [3, 4, 5]
