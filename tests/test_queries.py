"""Every query of the library runs, and equals its SQL where it has one."""

import pytest
from compare import database, same

from kilnmark.plans import catalog

SQL = catalog.oracle_sql()
ROWS_ONLY = sorted(set(catalog.queries()) - set(SQL))


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, db, name):
    same(catalog.queries()[name](spark, sf), db, SQL[name])


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
