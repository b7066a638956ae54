import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.functions import text
from termweave.functions.normal import normal_form, normal_items
from termweave.sources.formats import clean

CLEAN = [
    ("Context (archaeology", "Context"), ("Service (business)", "Service (business)"), ("(smart home)", "smart home"),
    ("Human–computer interaction", "Human-computer interaction"), ("  Fall Detection.  ", "Fall Detection"), ("((a)", "(a)"), ("a) b (c", "a) b (c"),
    ("养老。", "养老"), ("", ""), (None, ""), ("...", ""), ("a   b", "a b"), ("x)y", "xy"),
]


def test_clean_term(spark):
    df = spark.createDataFrame(CLEAN, "term string, expected string").select("term", text.clean_term(F.col("term")).alias("got"))
    got = {r["term"]: r["got"] for r in df.collect()}
    assert {t: got[t] for t, _ in CLEAN} == {t: clean(t) for t, _ in CLEAN}
    for term, expected in CLEAN[:5]:
        assert got[term] == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab() .,–", max_size=12))
def test_clean_balances(term):
    done = clean(term)
    assert done.count("(") == done.count(")")


def test_columns_agree_with_readers(spark):
    terms = [(t,) for t in ("a (b", "((a) b", "a) (b", "(a)(b)", "( )", "x – y", "((", "))", " (a (b) ", "‘q’")]
    rows = spark.createDataFrame(terms, "term string").select("term", text.clean_term(F.col("term")).alias("got")).collect()
    assert {r["term"]: r["got"] for r in rows} == {t: clean(t) for (t,) in terms}


@pytest.mark.parametrize("value,expected", [("2022", "2022"), ("c2019", ""), ("Spring 2015", "2015"), ("2022年", ""), ("1850", ""), (None, "")])
def test_year(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(text.year(F.col("v")).alias("y")).first()["y"] == expected


def test_keys_and_numbers(spark):
    df = spark.createDataFrame([("Smart-Homes", "1,234"), ("boxes", ""), ("养老é!", None)], "t string, c string")
    got = df.select(text.key_form(F.col("t")).alias("k"), text.citations(F.col("c")).alias("n"), text.split_multi(F.lit("a; b；;c")).alias("s")).collect()
    assert [r["k"] for r in got] == ["smart home", "box", "养老é"]
    assert [r["n"] for r in got] == [1234, None, None]
    assert got[0]["s"] == ["a", "b", "c"]


def test_equivalents(spark):
    df = spark.createDataFrame([("IoT for the elderly",), ("review",), ("HCI",)], "t string")
    assert [r[0] for r in df.select(text.equivalents(F.col("t"))).collect()] == ["internet of things for older adult", "review", "human-computer interaction"]


def test_normal_form(spark):
    assert normal_form("Ｈｅａｔ‐Pump__ Retro—fit ") == "heat pump retro fit"
    assert normal_form(None) is None
    df = spark.createDataFrame([(["A-b", None, ""],), (None,), ([],)], "x array<string>")
    assert [r[0] for r in df.select(normal_items("x")).collect()] == [["a b", None, ""], None, []]
