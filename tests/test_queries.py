import pytest

import __spark_entry__ as entry
from termweave import queries
from tests.oracle import FOLDER, compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    assert found.columns and found.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name,least", [("louvain", 0.05), ("keyword_louvain", 0.3)])
def test_communities_are_of_worth(spark, name, least):
    from termweave.operators import stats

    found = queries.QUERIES[name](spark, FOLDER)
    net = queries._net_k(spark, FOLDER) if name == "keyword_louvain" else queries._net_d(spark, FOLDER, least=queries.DOCS_MIN)[0]
    assert found.count() == net.nodes.count()
    assert stats.modularity(net.edges, found).first()["q"] >= least
