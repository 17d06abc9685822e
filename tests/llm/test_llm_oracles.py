import pytest
from compare import connect, differences, duck_rows, spark_rows

from starscan.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    found = spark_rows(QUERIES[name](spark, sf_dir))
    assert differences(found, duck_rows(duck, ORACLES[name])) is None
