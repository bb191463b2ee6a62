"""Every core query with SQL gives the rows of its SQL."""

import pytest
from oracle import both
from sessionloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_sql(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ours, theirs = both(df, ORACLES[name], SF)
        assert ours == theirs
    else:
        df.collect()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
