import pytest

from lumaframe.queries import ORACLE_SQL, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_filter_reaches_the_scan(spark, sf):
    plan = QUERIES["crop_embeddings"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id)" in plan
