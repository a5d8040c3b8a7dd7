import pytest

import __spark_entry__ as entry
from tests.oracle import difference, engine

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def db():
    return engine(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, FOLDER).columns
    else:
        assert difference(spark, query, sql, FOLDER, db) is None


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
