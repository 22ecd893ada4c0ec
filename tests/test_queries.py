"""Every query of the engine against its SQL, or that it runs where SQL cannot express it."""

import pytest
from conftest import values

from lexspan.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        assert values(got) == values(duck.execute(SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).columns) == 5
    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
