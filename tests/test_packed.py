import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.operators.packed import split_fields, split_strings

TERMS = [
    (None, []), ("", []), ("  ", []), ("; ;", []), ("one", ["one"]), ("a; b；c |d", ["a", "b", "c", "d"]), ("moisture, clay plaster", ["moisture, clay plaster"]),
    ("a,b", ["a", "b"]), ("a, b, c", ["a", "b", "c"]), ("x, y; z, w", ["x, y", "z, w"]), ('"x, y", "z"', ["x, y", "z"]), ('"a; b"; c', ["a; b", "c"]),
    ('"""big"" one"; two', ['"big" one', "two"]), ('["a, b", "c \\"d\\""]', ["a, b", 'c "d"']), ("['p', 'q']", ["p", "q"]), ("wet/dry / R&D", ["wet/dry", "R&D"]),
    ("a\nb\r\n\r\nc", ["a", "b", "c"]), ("a\tb", ["a", "b"]), ("甲、乙，丙", ["甲", "乙", "丙"]), ("a • b", ["a", "b"]),
    ('5" pipe; other', ['5" pipe', "other"]), ('["it\\u0027s"]', ["it's"]), ("[]", []), ("['a', \"b's\"]", ["a", "b's"]),
]
NAMES = [
    ("Doe, Jane", ["Doe, Jane"]), ("Doe, Jane and Roe, Max and {Council for X and Y}", ["Doe, Jane", "Roe, Max", "Council for X and Y"]), ("Doe J, Roe M", ["Doe J", "Roe M"]),
    ("J. Doe, M. Roe, and K. Poe", ["J. Doe", "M. Roe", "K. Poe"]), ("J. Doe & M. Roe", ["J. Doe", "M. Roe"]), ('"Doe, J", "Roe, M"', ["Doe, J", "Roe, M"]),
    ("Doe, Jane; Roe, Max | Poe, Kit", ["Doe, Jane", "Roe, Max", "Poe, Kit"]), ("Doe, Jane, Roe, Max", ["Doe, Jane", "Roe, Max"]), ("Doe, Jane AND Roe, Max", ["Doe, Jane", "Roe, Max"]),
]


@pytest.mark.parametrize("cell,expected", TERMS)
def test_terms(cell, expected):
    assert split_strings(pa.array([cell]), names=False).to_pylist() == [expected]


@pytest.mark.parametrize("cell,expected", NAMES)
def test_names(cell, expected):
    assert split_strings(pa.array([cell]), names=True).to_pylist() == [expected]


def test_batch_is_cellwise():
    cells = [c for c, _ in TERMS] * 3
    assert split_strings(pa.array(cells), names=False).to_pylist() == [e for _, e in TERMS] * 3
    assert split_strings(pa.array([], pa.string()), names=False).to_pylist() == []


word = st.text(alphabet="abc déü", min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=150, deadline=None)
@given(st.lists(word, min_size=2, max_size=6), st.sampled_from(["; ", ";", " | ", "\n", "；", " • "]))
def test_round_trip(values, mark):
    assert split_strings(pa.array([mark.join(values)]), names=False).to_pylist() == [values]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab,;"\\ é', min_size=1, max_size=8).map(str.strip).filter(lambda s: s.strip('"\\ ') == s and s), min_size=1, max_size=5))
def test_json_round_trip(values):
    assert split_strings(pa.array([json.dumps(values, ensure_ascii=False)]), names=False).to_pylist() == [values]


def test_table(spark):
    long = "; ".join(f"term {i}" for i in range(20000))
    df = spark.createDataFrame([(1, "Doe, J; Roe, K", "a; b", "x"), (2, None, "", "y"), (3, "Doe, J", long, "z"), (None, "Poe, L", None, "n")], "k long, authors string, keywords string, pos string")
    got = split_fields(df, "k", {"authors": True, "keywords": False})
    assert got.columns == ["k", "field", "pos", "item_text"]
    rows = got.collect()
    assert sorted((r["field"], r["pos"], r["item_text"]) for r in rows if r["k"] == 1) == [("authors", 0, "Doe, J"), ("authors", 1, "Roe, K"), ("keywords", 0, "a"), ("keywords", 1, "b")]
    assert not [r for r in rows if r["k"] == 2]
    assert sum(r["field"] == "keywords" for r in rows if r["k"] == 3) == 20000
    assert split_fields(df.limit(0), "k", {"authors": True}).count() == 0
