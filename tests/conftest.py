import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from brightledger.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def customers(spark):
    segments = ["Consumer", "Corporate", "Home Office"]
    rows = [(i, f"Customer {i}", segments[i % 3]) for i in range(1, 9)]
    return spark.createDataFrame(rows, "customer_id long, name string, segment string")


def order_rows(n):
    regions = ["North", "South", "East", "West"]
    return [(i, f"2024-{i % 6 + 1:02d}-15", i % 5 + 1, 100.0 + 10 * i, regions[i % 4]) for i in range(1, n + 1)]


@pytest.fixture(scope="session")
def orders(spark):
    def build(n=20):
        return spark.createDataFrame(order_rows(n), "order_id long, date string, customer_id long, amount double, region string")

    return build


def as_dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
