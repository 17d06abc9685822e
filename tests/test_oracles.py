"""Every registered query against its SQL twin on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry_module
from starscan.demo.queries import QUERIES as OWN

QUERIES = {name: query for name, query in entry_module.queries().items() if name in OWN}
ORACLES = {name: sql for name, sql in entry_module.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, duck, sf_dir, name):
    got = compare.spark_rows(QUERIES[name](spark, sf_dir))
    want = compare.duck_rows(duck, ORACLES[name])
    assert compare.differences(got, want) is None
