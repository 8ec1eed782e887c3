"""Every core query against its SQL, or at least run."""

import pytest

from tallywire import catalogue
from tests.oracle import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    columns, rows = rows_of(catalogue.QUERIES[name](spark, sf))
    assert len(set(columns)) == len(columns)
    if name in catalogue.ORACLES:
        assert (columns, rows) == rows_of_sql(con, catalogue.ORACLES[name])
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
