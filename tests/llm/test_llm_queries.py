import pytest

from termweave.llm import queries
from tests.oracle import FOLDER, compare

COLUMNS = {
    "p1_found": ["kind", "term", "mark"], "p3_found": ["term_a", "term_b"], "p4_found": ["record_id", "field"], "p5_found": ["name_a", "name_b"], "p6_found": ["record_id", "pos", "replace_by"],
    "p7_found": ["record_id", "cat_id"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "seg", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    if name in COLUMNS:
        assert found.columns == COLUMNS[name]
    assert found.count() == found.distinct().count() > 0
