import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termweave.functions.normal import normal_items
from termweave.llm import cooccurrence, frequency

SCHEMA = "unit long, terms array<string>, term string, units string, bucket int, n long"


def rows(seed=1, n=400):
    rng = random.Random(seed)
    out = [(i, [rng.choice(["hot", "Hot", f"t{rng.randrange(60)}", None, "", "a-b", "a b"]) for _ in range(rng.randrange(6))], "x", "y", 1, 2) for i in range(n)]
    return [*out, (n, None, "x", "y", 1, 2), (n + 1, [], None, None, None, None), (n + 2, ["hot"] * 5000, "x", "y", 1, 2)]


def brute(data):
    from termweave.functions.normal import normal_form

    total, units = Counter(), Counter()
    for _, terms, *_ in data:
        forms = [f for f in map(normal_form, terms or []) if f]
        total.update(forms)
        units.update(set(forms))
    return {t: (total[t], units[t]) for t in total}


@pytest.mark.parametrize("radix_bits,bucket_rows,more_bits", [(6, 1_000_000, 3), (2, 5, 2), (3, 1, 20)])
def test_counts(spark, radix_bits, bucket_rows, more_bits):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5).select("unit", normal_items("terms").alias("terms"), "units", "bucket")
    got = frequency.count_terms(frequency.record_counts(df, "unit", "terms"), radix_bits, bucket_rows, more_bits)
    assert {r["term"]: (r["occurrences"], r["units"]) for r in got.collect()} == brute(data)


def test_radix_on_disk(spark):
    """Counts lie in folders by leading hash bits; only oversized folders are written again, by more bits."""
    import os

    from termweave import session

    entries = spark.createDataFrame([(f"t{i}", 1, 1) for i in range(3000)] + [("hot", 2, 1)] * 3000, "term string, occurrences long, units long").repartition(7)
    before = len(session._written.get(spark.sparkContext.applicationId, []))
    got = {r["term"]: (r["occurrences"], r["units"]) for r in frequency.count_terms(entries, 2, 500, 2).collect()}
    assert got == {f"t{i}": (1, 1) for i in range(3000)} | {"hot": (6000, 3000)}
    levels = [p.removeprefix("file://") for p in session._written[spark.sparkContext.applicationId][before:] if "/radix" in p]
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in levels] == ["radix2", "radix4"]
    assert sorted(d for d in os.listdir(levels[0]) if d.startswith("bucket=")) == [f"bucket={i}" for i in range(4)]
    some = entries.filter(F.shiftrightunsigned(F.xxhash64("term"), 62) == 1).select("term").distinct()
    assert {r["term"] for r in spark.read.parquet(f"{levels[0]}/bucket=1").select("term").distinct().collect()} == {r["term"] for r in some.collect()}


def test_empty_and_marks(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert frequency.count_terms(frequency.record_counts(none, "unit", "terms")).count() == 0
    counts = spark.createDataFrame([("a", 1, 1), ("b", 9, 9), ("c", 9, 2)], "term string, occurrences long, units long")
    got = {r["term"]: r["mark"] for r in frequency.marks(counts, 2, F.col("units") > 5).collect()}
    assert got == {"a": "rare", "b": "common", "c": None}


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, [f"i{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randrange(5))] + ([None, ""] if i % 3 else [])) for i in range(300)] + [(300, None), (301, [])]
    df = spark.createDataFrame([(k, v, "x") for k, v in data], "k long, items array<string>, item string")
    got = {(r["item_a"], r["item_b"]): r for r in cooccurrence.scored_pairs(df, "k", "items", min_count=3).collect()}
    sets = [sorted({x for x in v or [] if x}) for _, v in data]
    single, pairs = Counter(x for s in sets for x in s), Counter((a, b) for s in sets for i, a in enumerate(s) for b in s[i + 1 :])
    want = {p: n for p, n in pairs.items() if n >= 3}
    assert {p: r["n_ab"] for p, r in got.items()} == want
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"], r["n"]) == (single[a], single[b], 302)
        assert r["lift"] == pytest.approx(r["n_ab"] * 302 / (single[a] * single[b]))


def test_pairs_share_and_empty(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i < 4 else ["c"]) for i in range(100)], "k long, items array<string>")
    assert cooccurrence.scored_pairs(df, "k", "items", 1, 0.05).count() == 0
    assert cooccurrence.scored_pairs(df, "k", "items", 1, 0.04).count() == 1
    assert cooccurrence.scored_pairs(df.limit(0), "k", "items").count() == 0


def test_long_basket(spark):
    df = spark.createDataFrame([(1, [f"t{i}" for i in range(300)]), (2, [f"t{i}" for i in range(300)])], "k long, items array<string>")
    assert cooccurrence.scored_pairs(df, "k", "items", 2).count() == 300 * 299 // 2


def test_counts_beyond_bigint_products(spark):
    """Counts near 10^10, whose products are beyond bigint."""
    big = 40_000_000_000
    df = spark.createDataFrame([("a", "b", 9_000_000_000, 13_000_000_000, 11_000_000_000, big), ("a", "c", 10**10, 10**9, 2 * 10**10, big), ("a", "d", 10**10, 10**9, 2 * 10**10 + 1, big)], "item_a string, item_b string, n_ab long, n_a long, n_b long, n long")
    got = {r["item_b"]: (r["yes"], r["more"]) for r in df.select("item_b", cooccurrence.at_least(20).alias("yes"), cooccurrence.at_least(2).alias("more")).collect()}
    assert got == {"b": (False, True), "c": (True, True), "d": (False, True)}
    lift, conviction = cooccurrence.measures()
    row = df.filter("item_b = 'b'").select(lift.alias("lift"), conviction.alias("conviction")).first()
    assert row["lift"] == pytest.approx(9e9 * big / (13e9 * 11e9)) and row["conviction"] == pytest.approx((1 - 11 / 40) / (1 - 9 / 13))
