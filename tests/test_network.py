from itertools import combinations

import pytest
from pyspark.sql import functions as F

from termweave.functions.rows import latest
from termweave.functions.statistics import hypergeometric_tail
from termweave.operators import graph, network, stats

DOCS = [(1, ["a", "b", "c"], 2000, 1), (2, ["a", "b"], 2002, None), (3, ["a", "c", "c", ""], None, 3), (4, ["b", "c"], 0, 4), (5, [], 2001, 1), (6, ["z", None], 2001, 1)]
SCHEMA = "doc_id long, terms array<string>, year int, citations long"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def test_toy(spark, corpus):
    net = network.build(corpus)
    nodes = {r["label"]: r for r in net.nodes.collect()}
    assert net.n_docs == 6 and sorted(nodes) == ["a", "b", "c"]
    assert [nodes[x]["id"] for x in "abc"] == [1, 2, 3] and all(nodes[x]["occurrences"] == 3 for x in "abc")
    assert {(r["src"], r["dst"]): r["weight"] for r in net.edges.collect()} == {(1, 2): 2.0, (1, 3): 2.0, (2, 3): 2.0}
    assert nodes["a"]["avg_year"] == 2001.0 and nodes["c"]["avg_year"] == 2000.0 and nodes["b"]["avg_citations"] == 2.5
    total = net.edges.agg(F.sum("weight")).first()[0]
    assert sum(n["total_link_strength"] for n in nodes.values()) == 2 * total


def test_fractional_counts_kept_terms(corpus):
    edges = network.build(corpus, "fractional").edges.collect()
    assert {(r["src"], r["dst"]): r["weight"] for r in edges} == {(1, 2): 1.5, (1, 3): 1.5, (2, 3): 1.5}


def test_threshold_and_limits(spark, corpus):
    assert network.suggest_min_occurrences(network.document_frequency(corpus), 2) == 3
    assert network.suggest_min_occurrences(network.document_frequency(corpus), 60) == 1
    assert [r["label"] for r in network.build(corpus, max_terms=2).nodes.orderBy("id").collect()] == ["a", "b"]
    drop = spark.createDataFrame([("a",)], "term string")
    assert sorted(r["label"] for r in network.build(corpus, drop=drop).nodes.collect()) == ["b", "c"]
    empty = network.build(corpus.limit(0))
    assert empty.nodes.count() == empty.edges.count() == 0


def test_range_numbering_agrees(spark, monkeypatch):
    kept = spark.createDataFrame([(f"t{i}", i % 7) for i in range(200)], "term string, df long")
    one = {r["label"]: r["id"] for r in network.numbered(kept).collect()}
    monkeypatch.setattr(network, "ONE_PARTITION", 10)
    assert {r["label"]: r["id"] for r in network.numbered(kept).collect()} == one


def test_long_document(spark):
    terms = [f"t{i:03d}" for i in range(150)]
    net = network.build(spark.createDataFrame([(1, terms, 2000, 1), (2, terms, 2000, 1)], SCHEMA))
    assert net.edges.count() == 150 * 149 // 2


TAILS = [(120, 20, 19, 0, 0.02268412828188221), (120, 20, 12, 0, 0.099633), (120, 19, 12, 0, 0.113067), (10, 5, 5, 5, 1.0), (10, 0, 5, 0, 1.0), (10, 9, 9, 7, 0.0), (5000, 400, 300, 10, None), (30, 12, 9, 3, None)]


@pytest.mark.parametrize("n,a,b,seen,expected", TAILS)
def test_tail(spark, n, a, b, seen, expected):
    from math import comb

    got = spark.range(1).select(hypergeometric_tail(*[F.lit(x) for x in (n, a, b, seen)]).alias("p")).first()["p"]
    if expected is None:
        expected = sum(comb(a, x) * comb(n - a, b - x) for x in range(max(0, a + b - n), seen + 1)) / comb(n, b)
    assert got == pytest.approx(expected, rel=1e-5 if expected in (0.099633, 0.113067) else 1e-9)


EDGES = [(1, 2, 3.0), (2, 3, 3.0), (1, 3, 3.0), (4, 5, 2.0), (5, 6, 2.0), (4, 6, 2.0), (3, 4, 0.5)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(i,) for i in range(1, 9)], "id long"), spark.createDataFrame([*EDGES, (7, 8, 0.0)], "src long, dst long, weight double")


def test_components(toy):
    nodes, edges = toy
    assert {r["id"]: r["component"] for r in graph.connected_components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 8}
    kept, links = graph.largest_component(nodes, edges)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6] and links.count() == 7


def test_path_component(spark):
    n = 60
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], "src long, dst long, weight double")
    assert {r["component"] for r in graph.connected_components(nodes, edges).collect()} == {0}


def test_louvain(spark, toy):
    nodes, edges = toy
    found = {r["id"]: r["cluster"] for r in graph.louvain(nodes, edges).collect()}
    assert found[1] == found[2] == found[3] != found[4] == found[5] == found[6]
    q = stats.modularity(edges.filter("weight > 0"), spark.createDataFrame(list(found.items()), "id long, cluster long")).first()["q"]
    assert 0.3 < q <= 1
    assert {r["cluster"] for r in graph.louvain(nodes, edges.limit(0)).collect()} == {1}


def test_betweenness(toy):
    nodes, edges = toy
    found = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, edges).collect()}
    # All paths between the triangles run through 3 and 4: 2 * 3 * 2 ordered pairs each, both ways, over 7 * 6.
    assert found[3] == pytest.approx(2 * 2 * 3 / 42) and found[4] == pytest.approx(2 * 2 * 3 / 42) and found[1] == 0.0
    with pytest.raises(ValueError):
        graph.betweenness(nodes, edges, held_edges=2)


def test_modularity_by_hand(spark, toy):
    _, edges = toy
    clusters = {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}
    m = sum(w for *_, w in EDGES)
    q = 0.0
    for c in (1, 2):
        inside = sum(w for a, b, w in EDGES if clusters[a] == clusters[b] == c)
        ends = sum(w * ((clusters[a] == c) + (clusters[b] == c)) for a, b, w in EDGES)
        q += inside / m - (ends / (2 * m)) ** 2
    got = stats.modularity(edges.filter("weight > 0"), spark.createDataFrame(list(clusters.items()), "id long, cluster long")).first()["q"]
    assert got == pytest.approx(q)


def test_gaps(spark):
    docs = [(i, ["a"] if i < 40 else ["b"], 2000, 1) for i in range(80)]
    net = network.build(spark.createDataFrame(docs, SCHEMA))
    clusters = spark.createDataFrame([(1, 1), (2, 2)], "id long, cluster long")
    pair = stats.gap_pairs(net.nodes, net.edges, clusters, net.n_docs).first()
    assert pair["actual"] == 0 and pair["expected"] == 20.0 and pair["significant"]
    assert stats.gap_pairs(net.nodes, net.edges, spark.createDataFrame([(1, 1), (2, 1)], "id long, cluster long"), net.n_docs).count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, None, "c"), (None, 1, "d")], "k long, t long, v string")
    assert sorted((r["k"], r["v"]) for r in latest(df, ["k"], ["t"]).collect()) == [(1, "b"), (2, "c")]


def test_pairs_brute_force(spark, corpus):
    want = {}
    for _, terms, *_ in DOCS:
        for a, b in combinations(sorted({t for t in terms if t and t != "z"}), 2):
            want[a, b] = want.get((a, b), 0) + 1
    net = network.build(corpus)
    got = network.with_labels(net.edges, net.nodes).collect()
    assert {(r["label_a"], r["label_b"]): r["weight"] for r in got} == want


def test_layout(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    layout = spark.createDataFrame([(1, 0.5, -1.0, 3)], "id long, x double, y double, cluster int")
    assert sorted(tuple(r) for r in network.with_layout(nodes, layout).collect()) == [(1, "a", 0.5, -1.0, 3), (2, "b", 0.0, 0.0, 1)]
    other = spark.createDataFrame([("a",), ("c",)], "label string")
    assert sorted(tuple(r) for r in network.label_differences(nodes, other).collect()) == [("b", "other"), ("c", "nodes")]
    assert network.label_differences(nodes, nodes).count() == 0
