import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import mapping

ENTRIES = ["heat pump retrofit", "heat pump noise", "green roof irrigation", "cork facade moisture", "field observation"]


def distance(a, b):
    """Optimal string alignment distance, plainly."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc ", min_size=1, max_size=7), min_size=1, max_size=12), st.text(alphabet="abcd ", min_size=1, max_size=7), st.integers(0, 2))
def test_automaton_against_brute_force(entries, word, most):
    trie = mapping.Trie([(e, e) for e in entries])
    got = {}
    for d, text, _ in trie.within(word, most):
        got[text] = min(d, got.get(text, 9))
    assert got == {e: distance(e, word) for e in set(entries) if distance(e, word) <= most}


CASES = [
    ("Heat-Pump Retrofit", "heat pump retrofit"), ("heat pupm retrofit", "heat pump retrofit"), ("retrofit of heat pumps", "heat pump retrofit"), ("retrofit, heat pump", "heat pump retrofit"),
    ("heatpump noise", "heat pump noise"), ("‘green roof irigation’", "green roof irrigation"), ("cork facade mois.", "cork facade moisture"), ("cork facade moisture [Place]", "cork facade moisture"),
    ("Cork Facade Moisture (CFM)", "cork facade moisture"), ("studies of field observation", "field observation"), ("hp retrofits", "heat pump retrofit"), ("heat pump litigation", ""), ("roof", ""), ("", ""), ("none at all", ""),
    ("old topic", ""), ("ｈｅａｔ ｐｕｍｐ ｎｏｉｓｅ", "heat pump noise"),
]


@pytest.fixture(scope="module")
def rules(spark):
    rows = [(e, e) for e in ENTRIES] + [("hp retrofit", "retrofitting of hp"), ("retrofitting of hp", " heat pump retrofit "), ("old topic", None), (" ", "x y z"), ("loop a", "loop b"), ("loop b", "loop a")]
    return spark.createDataFrame([(label, to, i, "z") for i, (label, to) in enumerate(rows)], "label string, replace_by string, i int, value string")


def test_cases(spark, rules):
    values = spark.createDataFrame([(v,) for v, _ in CASES] + [(None,), ("heat pump noise",), ("x" * 20000,)], "value string")
    for block in (50_000, 3):
        found = {r["value"]: r for r in mapping.map_values(values, rules, order=("i",), block=block).collect()}
        assert {v: found[v]["entry"] for v, _ in CASES} == dict(CASES)
        assert found["heat pump noise"]["is_canonical"] and found[None]["entry"] == "" and found["x" * 20000]["entry"] == ""


def test_paths():
    paths, canonical = mapping.reference_paths([("a", "b"), ("b", "c"), ("d", ""), ("c", "c"), ("e", "f"), ("f", "e")])
    assert canonical == {"c"} and dict(paths)["a"] == "c" and dict(paths)["d"] == ""


def test_empty(spark, rules):
    none = spark.createDataFrame([], "value string")
    assert mapping.map_values(none, rules, order=("i",)).count() == 0
    some = spark.createDataFrame([("a",)], "value string")
    assert mapping.map_values(some, rules.limit(0)).first()["entry"] == ""


def test_typos_are_recovered():
    trie = mapping.Trie([(e, e) for e in ENTRIES])
    rng = random.Random(5)
    right = 0
    for _ in range(300):
        e = rng.choice(ENTRIES)
        i = rng.randrange(1, len(e) - 1)
        typo = rng.choice([e[:i] + e[i + 1 :], e[:i] + e[i] + e[i:], e[:i] + "x" + e[i + 1 :]])
        right += (mapping.match(trie, typo) or (0, ""))[1] == e
    assert right >= 290


def test_joined_and_parted_words():
    """One edit that joins or parts words changes every word; the entry is found all the same."""
    trie = mapping.Trie([(e, e) for e in ("microgrid", "daylighting", "rainwater", "rain barrel", "roof top garden")])
    for value, entry in (("micro-grid", "microgrid"), ("day lighting", "daylighting"), ("rain water", "rainwater"), ("rainbarrel", "rain barrel"), ("rooftop garden", "roof top garden")):
        assert mapping.match(trie, value) == (1, entry) or mapping.match(trie, value) == (0, entry)


def test_blocks_change_nothing(spark):
    """Ties, nearer entries and repeated values come out the same however many blocks the list is searched in."""
    names = ["harbour pilot", "harbour pilots", "harbor pilot", "garbour pilot", "lantern keeping", "lantern keeper", "cask", "cast", "old mill"]
    rules = spark.createDataFrame([(n, n) for n in names] + [("old mil", None)], "label string, replace_by string")
    values = spark.createDataFrame([(v,) for v in ("harbour pilot", "arbour pilot", "lantern keepin", "lantern keepng", "lantern keepe", "casr", "cask", "cask", "old mil", "Old Mill", "", None)], "value string")
    want = None
    for block in (50_000, 4, 1):
        got = sorted(map(tuple, mapping.map_values(values, rules, block=block).collect()), key=repr)
        assert len(got) == 12 and (want is None or got == want)
        want = got
    rows = {(r["value"], r["entry"], r["distance"]) for r in mapping.map_candidates(values, rules, block=3).collect()}
    assert {("arbour pilot", "harbour pilot", 1), ("arbour pilot", "garbour pilot", 1), ("arbour pilot", "harbor pilot", 2), ("arbour pilot", "harbour pilots", 2)} <= rows
    assert not [r for r in rows if r[0] in ("casr", "", None)]
