"""Every registered query against its SQL twin; queries without one must give rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, database
from creditspark.plans.catalog import QUERIES

SQL = oracle_sql()
TRAINING = {"train_and_report"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return database(sf_dir)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(queries())
    assert set(QUERIES) - set(SQL) == TRAINING


def test_entry_gives_the_two_classes(spark):
    assert entry(spark).count() == 2


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, duck, sf_dir, name):
    verdict = compare(spark, duck, name, queries()[name], SQL[name], sf_dir)
    assert verdict.startswith("ok"), verdict
