"""Communities, components, numbers and gaps beyond the toy sizes: planted groups, brute force, both ways of working."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from termweave.operators import graph, network, stats


def planted(spark, groups=6, size=12, seed=4):
    """Groups of nodes with many links within and few between them."""
    rng = random.Random(seed)
    edges = {}
    for g in range(groups):
        for a, b in combinations(range(g * size, (g + 1) * size), 2):
            if rng.random() < 0.6:
                edges[a + 1, b + 1] = 1.0 + rng.random()
    for _ in range(groups * size // 2):
        a, b = sorted(rng.sample(range(groups * size), 2))
        edges.setdefault((a + 1, b + 1), 0.5)
    nodes = spark.createDataFrame([(i + 1,) for i in range(groups * size + 2)], "id long")
    return nodes, spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_planted_communities(spark, one_task):
    nodes, edges = planted(spark, *((6, 12) if one_task else (3, 8)))
    size = 12 if one_task else 8
    found = {r["id"]: r["cluster"] for r in graph.louvain(nodes, edges, one_task=one_task).collect()}
    groups = (len(found) - 2) // size
    assert len(set(found.values())) == groups + 2  # two nodes without edges are clusters of their own
    assert all(len({found[g * size + i + 1] for i in range(size)}) == 1 for g in range(groups))
    assert sorted(set(found.values())) == list(range(1, groups + 3)) and found[len(found)] > groups


def test_both_ways_agree(spark):
    nodes, edges = planted(spark, 3, 7, 9)
    one, other = (stats.modularity(edges, graph.louvain(nodes, edges, one_task=n)).first()["q"] for n in (10**6, 0))
    assert one == pytest.approx(other, abs=0.02) and one > 0.4


def test_communities_of_a_path_and_too_many_turns(spark, monkeypatch):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1, 2000)], "src long, dst long, weight double")
    nodes = spark.range(1, 2001)
    q = stats.modularity(path, graph.louvain(nodes, path)).first()["q"]
    assert q > 0.95
    monkeypatch.setattr(graph, "MOST_TURNS", 1)
    import numpy as np

    with pytest.raises(RuntimeError):
        graph._communities(np.arange(50), np.arange(1, 51), np.ones(50), 1.0)


def test_components_end_or_fail(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1, 300)], "src long, dst long, weight double")
    nodes = spark.range(1, 302)
    found = {r["id"]: r["cluster"] for r in graph.numbered_components(graph.connected_components(nodes, chain)).collect()}
    assert found == {i: 1 for i in range(1, 301)} | {301: 2}
    with pytest.raises(RuntimeError):
        graph.connected_components(nodes, chain, max_rounds=2)


def test_numbers_by_ranges(spark):
    rows = [(f"t{i:04d}", i % 17) for i in range(500)]
    df = spark.createDataFrame(rows, "term string, df long")
    order = [F.desc("df"), F.asc("term")]
    one = {r["term"]: r["n"] for r in network.row_numbers(df, order, "n").collect()}
    parts = {r["term"]: r["n"] for r in network.row_numbers(df, order, "n", one_partition=10).collect()}
    assert one == parts == {t: i + 1 for i, (t, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_gaps_by_bands_against_all_pairs(spark):
    rng = random.Random(6)
    nodes = [(i + 1, f"t{i}", rng.choice([1, 2, 3, 7, 8, 15, 16, 40, 100])) for i in range(60)]
    cluster = {i: rng.randrange(3) for i, _, _ in nodes}
    n_docs = 200
    df = spark.createDataFrame([(i, label, occ, 0.0, 0.0, 0.0) for i, label, occ in nodes], "id long, label string, occurrences long, total_link_strength double, avg_year double, avg_citations double")
    edges = {(a[0], b[0]): float(rng.randrange(1, 4)) for a, b in combinations(nodes, 2) if rng.random() < 0.2}
    found = stats.gap_pairs(df, spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double"), spark.createDataFrame(list(cluster.items()), "id long, cluster int"), n_docs)
    got = sorted((r["id_a"], r["id_b"]) for r in found.collect())
    want = sorted((a[0], b[0]) for a, b in combinations(nodes, 2) if min(a[2], b[2]) >= 2 and cluster[a[0]] != cluster[b[0]] and a[2] * b[2] >= n_docs and edges.get((a[0], b[0]), 0) / (a[2] * b[2] / n_docs) < 0.35)
    assert got == want and len(want) > 50


def test_scratch(spark):
    """Tables written within the block are gone after it; earlier ones stay."""
    from termweave.session import cut, scratch

    kept = cut(spark.range(3), "kept")
    with scratch(spark):
        inner = cut(spark.range(4), "inner")
        assert inner.count() == 4
    assert kept.count() == 3
    with pytest.raises(Exception):
        inner.count()
