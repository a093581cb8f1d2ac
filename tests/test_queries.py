"""Every registered engine query beside its SQL in DuckDB."""

import pytest

from quarrystone.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_has_rows(name, spark, small):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
