import pytest
from pyspark.sql import functions as F

from termweave.operators import network, rules


def mapping(spark, pairs):
    return spark.createDataFrame(pairs, "label string, target string")


@pytest.mark.parametrize(
    "pairs,expected",
    [
        ([("x", "y"), ("y", "z")], {"x": "z", "y": "z"}),
        ([("a", "b"), ("b", "a")], {"b": "a"}),
        ([("c", "a"), ("a", "b"), ("b", "a")], {"b": "a", "c": "a"}),
        ([("a", "b"), ("b", "c"), ("c", "a"), ("q", "b")], {"b": "a", "c": "a", "q": "a"}),
        ([("x", "x"), ("y", "x")], {"y": "x"}),
        ([(f"n{i}", f"n{i + 1}") for i in range(20)], {f"n{i}": "n20" for i in range(20)}),
    ],
)
def test_resolve(spark, pairs, expected):
    assert {r["label"]: r["target"] for r in rules.resolve(mapping(spark, pairs)).collect()} == expected


def test_groups_and_priority(spark):
    docs = [(i, [t]) for i, t in enumerate(["Older Adults"] * 3 + ["older adult"] * 2 + ["older-adults"])]
    corpus = spark.createDataFrame(docs, "doc_id long, terms array<string>")
    auto = rules.auto_groups(network.document_frequency(corpus))
    assert sorted((r["canonical"], r["member"]) for r in auto.collect()) == [("Older Adults", "older adult"), ("Older Adults", "older-adults")]
    manual = rules.ordered_rules(spark.createDataFrame([("Older Adults", "older adult", 1)], "label string, replace_by string, seq long"))
    got = {r["label"]: r["target"] for r in rules.full_mapping(auto, manual).collect()}
    assert got == {"Older Adults": "older adult", "older-adults": "older adult"}


def test_merge(spark):
    corpus = spark.createDataFrame([(1, ["A-x", "b", "B", "drop me"]), (2, ["gone", "b"]), (3, [" "]), (4, [])], "doc_id long, terms array<string>")
    given = rules.ordered_rules(spark.createDataFrame([("a x", "alpha", 1), ("B", "b", 2), ("drop me", "", 3), ("gone", "drop me", 4), (" ", "q", 5)], "label string, replace_by string, seq long"))
    merged, statuses = rules.merge_terms(corpus, rules.full_mapping(None, given), rules.drop_terms(given))
    assert {r["doc_id"]: r["terms"] for r in merged.collect()} == {1: ["alpha", "b"], 2: ["b"], 3: [], 4: []}
    assert rules.merge_stats(statuses).first().asDict() == {"merged": 2, "dropped": 2, "kept": 2}


def test_later_rule_wins_and_drops_stay(spark):
    first = spark.createDataFrame([("a", "x", 1), ("d", "", 2)], "label string, replace_by string, seq long")
    second = spark.createDataFrame([("a", "y", 1), ("d", "kept", 1)], "label string, replace_by string, seq long")
    both = rules.ordered_rules(first, second)
    assert {r["label"]: r["target"] for r in rules.winning(both).collect()} == {"a": "y", "d": "kept"}
    assert [r["term"] for r in rules.drop_terms(both).collect()] == ["d"]


def test_candidates(spark):
    frequency = spark.createDataFrame([("digital technology", 9), ("digital technologys", 8), ("smart home", 7), ("smart home care", 5), ("zebra", 1)], "term string, df long")
    got = {(r["canonical"], r["member"], r["kind"]) for r in rules.fuzzy_candidates(frequency).collect()}
    assert ("smart home", "smart home care", "containment") in got
    frequency = spark.createDataFrame([("digitization technology", 9), ("digitisation technology", 8)], "term string, df long")
    row = rules.fuzzy_candidates(frequency).first()
    assert row["kind"] == "similarity" and row["similarity"] > 0.9 and row["rate"] is None


def test_generic(spark):
    frequency = spark.createDataFrame([("Machine Learning", 3), ("Case-Study", 2), ("模型", 1), ("mine", 1)], "term string, df long")
    kept, dropped = rules.drop_generic(frequency, ["Mine"])
    assert [r["term"] for r in kept.collect()] == ["Machine Learning"]
    assert sorted(r["term"] for r in dropped.collect()) == ["Case-Study", "mine", "模型"]
    assert kept.select(F.col("df")).first()[0] == 3


def test_targets_that_are_labels_in_normal_form(spark):
    """A chain goes on where its target is a label in another case or with other hyphens."""
    corpus = spark.createDataFrame([(1, ["A B", "a-b", "C D", "c_d", "keep"])], "doc_id long, terms array<string>")
    given = rules.ordered_rules(spark.createDataFrame([("A B", "c d", 1), ("C D", "e", 2)], "label string, replace_by string, seq long"))
    merged, statuses = rules.merge_terms(corpus, rules.full_mapping(None, given), rules.drop_terms(given))
    assert merged.first()["terms"] == ["e", "keep"]
    assert rules.merge_stats(statuses).first().asDict() == {"merged": 4, "dropped": 0, "kept": 1}


def test_groups_and_rules_together(spark):
    """Automatic groups and rules that turn against each other leave one spelling of each term."""
    lists = [["older adults", "smart home"], ["older adults", "IoT"], ["older adults", "AAL"], ["Older adults", "smart home"], ["older adult", "falls"], ["smart home", "smart homes"], ["Smart home", "elderly"], ["older adults", "dementia"]]
    corpus = spark.createDataFrame(list(enumerate(lists)), "doc_id long, terms array<string>")
    given = rules.ordered_rules(spark.createDataFrame([("older adults", "older adult", 1), ("elderly", "older adult", 2), ("IoT", "internet of things", 3), ("AAL", "ambient assisted living", 4), ("smart homes", "smart home", 5)], "label string, replace_by string, seq long"))
    mapping = rules.full_mapping(rules.auto_groups(network.document_frequency(corpus)), given)
    merged, _ = rules.merge_terms(corpus, mapping, rules.drop_terms(given))
    found = {t for r in merged.collect() for t in r["terms"]}
    assert found == {"older adult", "smart home", "internet of things", "ambient assisted living", "falls", "dementia"}
