"""Every registered query against its SQL, on whole tables."""

import pytest

from cellsift.plans import catalog
from cellsift.plans.check import compare

catalog.load_all()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    ok, note = compare(spark, sf, catalog.QUERIES[name], catalog.ORACLE.get(name))
    assert ok, note


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 12
