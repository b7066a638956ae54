import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import mixing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 300))
def test_fill_is_best(counts, budget):
    take = mixing.fill(counts, budget)
    got = sum(n * k for n, k in take.items())
    assert all(0 < k <= counts[n] for n, k in take.items()) and got <= budget
    reach = {0}
    for n, c in counts.items():
        reach = {s + n * k for s in reach for k in range(c + 1)}
    best = max(s for s in reach if s <= budget)
    # Small cases are solved by the knapsack alone only if no share was fixed before; never more than the shortest gap off.
    assert best - got <= max(counts)


def test_fill_exact_on_many():
    rng = random.Random(1)
    counts = {n: rng.randrange(1, 50) for n in range(20, 600)}
    total = sum(n * c for n, c in counts.items())
    for budget in (total // 3, total // 7 + 1, total // 2):
        take = mixing.fill(counts, budget)
        assert sum(n * k for n, k in take.items()) == budget
    assert mixing.fill(counts, total + 5) == counts and mixing.fill(counts, 0) == {} and mixing.fill({}, 9) == {}


def test_plan():
    plans = mixing.plan({"a": {10: 10}, "b": {5: 100}}, {"a": (0.5, 3), "b": (0.4, 1), "none": (0.1, 2)})
    assert plans["a"].tokens == 300 and plans["a"].uses == {10: 30} and plans["b"].tokens == 240 and plans["none"].tokens == 0
    fixed = mixing.plan({"a": {10: 10}}, {"a": (1.0, 5)}, total=250)["a"]
    assert fixed.uses == {10: 25} and fixed.tokens == 250
    assert mixing.plan({}, {"a": (1.0, 1)})["a"].tokens == 0


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else "small", " ".join(rng.choice(["word", "ünï", "12"]) for _ in range(rng.randrange(1, 40))), 1) for i in range(600)]
    rows += [(1000, None, "x", 1), (1001, "unlisted", "x", 1), (1002, "hot", None, 1), (1003, "hot", "", 1), (1004, "small", "long " * 20000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("hot", 0.5, 1), ("small", 0.45, 3), ("gone", 0.05, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_mix(tables):
    docs, targets = tables
    chosen, shares = mixing.mix(docs, targets, "doc_id", "text", seed=3)
    used = chosen.collect()
    assert len({r["doc_id"] for r in used}) == len(used)
    assert all(1 <= r["uses"] <= (1 if r["source"] == "hot" else 3) for r in used) and not {1000, 1001, 1002, 1003} & {r["doc_id"] for r in used}
    got = {r["source"]: r for r in shares.collect()}
    assert got["gone"]["tokens"] == 0 and set(got) == {"hot", "small", "gone"}
    for s, share in (("hot", 0.5 / 0.95), ("small", 0.45 / 0.95)):
        assert got[s]["tokens"] == sum(r["tokens"] * r["uses"] for r in used if r["source"] == s)
        assert got[s]["reached_share"] == pytest.approx(share, abs=0.002)
    again = {(r["doc_id"], r["uses"]) for r in mixing.mix(docs.repartition(7), targets, "doc_id", "text", seed=3)[0].collect()}
    assert again == {(r["doc_id"], r["uses"]) for r in used}


def test_tokens_and_empty(spark, tables):
    import base64

    import tiktoken

    docs, targets = tables
    counted = {r["doc_id"]: r["n"] for r in mixing.token_counts(docs, "text", name="n").collect()}
    with open(mixing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("x", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(counted[r["doc_id"]] == (len(enc.encode_ordinary(r["text"])) if r["text"] else 0) for r in docs.collect())
    chosen, shares = mixing.mix(docs.limit(0), targets, "doc_id", "text")
    assert chosen.count() == 0 and shares.count() == 3
