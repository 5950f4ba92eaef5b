"""Every query runs; those with SQL equal DuckDB's result."""

import pytest
from oracle import check

from furrow.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    query = catalogue.QUERIES[name]
    if name in catalogue.ORACLES:
        check(spark, name, query, catalogue.ORACLES[name], SF)
    else:
        assert query(spark, SF).count() > 0


def test_entry_has_no_stray_sql():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
