import pytest

from quern.registered import QUERIES, SQL

from .parity import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, QUERIES[name], SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
