import pytest

from driftline import queries
from driftline.sources.catalog import TABLES

from .compare import engine, rows

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return engine(ROOT)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_its_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, ROOT).toPandas()
    if name not in queries.ORACLE:
        assert len(got)
        return
    want = sql.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(TABLES) == 14
