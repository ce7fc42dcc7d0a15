"""Every registered query against its SQL counterpart, and a skewed copy of some of them."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["person_id", "birth_datetime", "sex_at_birth", "src_id"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    good, note = compare(spark, con, name, entry.queries(), entry.oracle_sql(), SF_DIR)
    assert good, note
