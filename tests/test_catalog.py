"""Every query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from sievewright.plans import catalog
from tests.conftest import SF

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, same, name):
    same(QUERIES[name](spark, SF), ORACLE[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["topic", "rank", "chunk_id", "tokens", "qa_score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
