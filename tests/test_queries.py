"""Every registered query of the document-analytics operators against its SQL twin on the smallest tables."""

import pytest
from compare import check, connect

from docmill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        check(df, con, catalog.SQL[name])
    else:
        assert len(df.columns) == len(set(df.columns))
        df.collect()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
