import pytest

from codefacts.plans import catalog
from tests.conftest import SF, as_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert as_rows(got) == as_rows(tables.sql(catalog.SQL[name]).df())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
