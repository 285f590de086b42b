"""Every catalogue query that has SQL, against DuckDB on the smallest tables."""

import pytest
from compare import oracle, same

from heddle.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), oracle(SF), catalog.SQL[name])


def test_entry_point_has_all(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
