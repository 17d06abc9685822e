from __future__ import annotations

import pytest

from starscan.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4,
        app="tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": "/tmp/starscan-test-warehouse",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
