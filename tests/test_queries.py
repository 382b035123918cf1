"""Every registered query against its SQL, and the shape of the entry points."""

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert compare.compare(got, duck.execute(sql).df()) is None
    else:
        assert len(got.columns) > 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
