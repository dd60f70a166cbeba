from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfmargin.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("SHELFMARGIN_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_tables(spark, sf_dir):
    from shelfmargin.sources import testbed

    return {
        "orders": testbed.order_lines(spark, sf_dir).cache(),
        "product": testbed.product(spark, sf_dir),
        "location": testbed.location(spark, sf_dir),
        "catalog": testbed.product_catalog(spark, sf_dir),
    }
