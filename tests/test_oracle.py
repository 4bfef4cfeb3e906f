"""Every registered query against its SQL twin on the smallest data set."""

import pytest

from oracle import compare, connect
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    if name in oracle_sql():
        assert compare(got, duck.execute(oracle_sql()[name]).df()) == ""
    else:
        assert len(got) > 0


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["query_id", "id", "rank", "score"]
    assert rows.count() > 0
