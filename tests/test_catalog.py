"""Every query of the core against its SQL in DuckDB; those without SQL must run and give rows."""

import pytest
from compare import rows, rows_sql

from lodevec.plans import catalog, problems

QUERIES = {**problems.QUERIES, **catalog.QUERIES}
SQL = {**problems.SQL, **catalog.SQL}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    got = QUERIES[name](spark, data)
    if name not in SQL:
        assert got.columns and got.count() > 0
        return
    names, want = rows_sql(duck, SQL[name])
    assert sorted(got.columns) == names
    assert rows(got) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
