"""Every registered query against its SQL on whole tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import differences, duck


@pytest.fixture(scope="module")
def db(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert differences(spark, db, sf_dir, name) == []


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_all_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark, sf_dir):
    assert contract.entry(spark).limit(1).count() == 1
