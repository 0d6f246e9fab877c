"""Every registered query against DuckDB, or at least run, on the smallest tables."""

import pytest

from sparkmere import catalogue
from tests.compare import connect, of_duckdb, of_spark

SF = "/root/testdata/sf0.001"
catalogue.load_all()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    found = of_spark(catalogue.QUERIES[name](spark, SF))
    if name in catalogue.ORACLES:
        assert found == of_duckdb(connect(SF), catalogue.ORACLES[name])
    else:
        assert found[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
