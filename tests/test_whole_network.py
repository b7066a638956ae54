"""Queries over the whole document network, on a table large enough that a share of the documents is no small number."""

import random
from itertools import combinations
from math import comb

import pytest

from termweave import queries

LEAST, DOCS = 5, 240
COMMON = [f"common{a}" for a in "abcdef"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, (words, lang) of each document): words of 5 to 11 documents, fewer than one in twenty, and rarer ones."""
    rng = random.Random(5)
    docs = [({w for w in COMMON if rng.random() < 0.4}, ("en", "de")[i % 2]) for i in range(DOCS)]
    for n in range(60):
        word = "word" + "".join(chr(97 + int(d)) for d in f"{n:03}")
        for i in rng.sample(range(n % 2, DOCS, 2), 3 + n % 9):
            docs[i][0].add(word)
    folder = tmp_path_factory.mktemp("whole")
    rows = [(i, " ".join(sorted(w)), lang, 2000 + i % 20) for i, (w, lang) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, pub_year int").write.parquet(f"{folder}/documents.parquet")
    return str(folder), docs


@pytest.fixture(scope="module")
def net(corpus):
    """(documents of each word, documents of each pair, cluster of each word) by brute force."""
    docs = corpus[1]
    of = {}
    for words, _ in docs:
        for w in words:
            of[w] = of.get(w, 0) + 1
    of = {w: n for w, n in of.items() if n >= LEAST}
    pairs, labels = {}, {w: {"de": 0, "en": 0} for w in of}
    for words, lang in docs:
        for a, b in combinations(sorted(w for w in words if w in of), 2):
            pairs[a, b] = pairs.get((a, b), 0) + 1
        for w in words & of.keys():
            labels[w][lang] += 1
    return of, pairs, {w: min((-n, lang) for lang, n in c.items())[1] for w, c in labels.items()}


def quality(pairs, cluster):
    m = sum(pairs.values())
    inside = sum(n for (a, b), n in pairs.items() if cluster[a] == cluster[b]) / m
    ends = [sum(n * ((cluster[a] == c) + (cluster[b] == c)) for (a, b), n in pairs.items()) for c in set(cluster.values())]
    return inside - sum((e / (2 * m)) ** 2 for e in ends)


def test_network(spark, corpus, net):
    of, pairs, cluster = net
    row = queries.QUERIES["network_metrics_whole"](spark, corpus[0]).first()
    assert (row["n_docs"], row["n_nodes"], row["n_edges"], row["n_clusters"]) == (DOCS, len(of), len(pairs), 2)
    assert row["mean_association"] == pytest.approx(sum(n / (of[a] * of[b]) for (a, b), n in pairs.items()) / len(pairs), abs=1e-8)
    q = queries.QUERIES["modularity_whole"](spark, corpus[0]).first()["q"]
    assert q == pytest.approx(quality(pairs, cluster), abs=1e-8) and row["q"] == pytest.approx(q)
    profile = {r["cluster"]: r for r in queries.QUERIES["cluster_profile_whole"](spark, corpus[0]).collect()}
    assert {c: (r["size"], r["total_occurrences"]) for c, r in profile.items()} == {i + 1: (sum(c == x for c in cluster.values()), sum(of[w] for w in of if cluster[w] == x)) for i, x in enumerate(("de", "en"))}
    assert any(n < DOCS // queries.DOCS_SHARE for n in of.values())


def test_gaps(spark, corpus, net):
    of, pairs, cluster = net
    want = {}
    for a, b in combinations(sorted(of), 2):
        seen, oa, ob = pairs.get((a, b), 0), of[a], of[b]
        if cluster[a] != cluster[b] and oa * ob >= DOCS and seen < 0.35 * oa * ob / DOCS:
            want[a, b] = sum(comb(oa, x) * comb(DOCS - oa, ob - x) for x in range(max(0, oa + ob - DOCS), seen + 1)) / comb(DOCS, ob)
    got = {tuple(sorted((r["term_a"], r["term_b"]))): r["p_value"] for r in queries.QUERIES["gaps_whole"](spark, corpus[0]).collect()}
    assert got == pytest.approx(want, abs=2e-6) and any(min(of[a], of[b]) < DOCS // queries.DOCS_SHARE for a, b in want)
    row = queries.QUERIES["gap_summary_whole"](spark, corpus[0]).first()
    assert (row["n_tested"], row["n_significant"]) == (len(want), sum(p < 0.05 for p in want.values()))


def test_louvain(spark, corpus, net):
    found = queries.QUERIES["louvain"](spark, corpus[0])
    assert found.count() == len(net[0]) and found.select("id").distinct().count() == len(net[0])
