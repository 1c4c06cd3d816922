import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veilwright.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("veilwright-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture
def setting(spark):
    """Set a session option for one test."""
    before = {}

    def change(key, value):
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def people(spark):
    rows = [
        (1, -1, "M", "1000", 30.0, -118.95, "flu"), (2, 5, "F", "1000", 30.1, -118.95, "flu"),
        (3, 5, "F", "1000", 30.1, -118.95, "cold"), (4, 10, "M", "1001", 30.2, -118.0, "flu"),
        (5, 10, "M", "1001", 30.2, -118.0, "flu"), (6, 20, None, "1001", 31.0, -200.0, "cold"),
        (7, 20, "-", "1002", 31.0, 300.0, "flu"), (8, 101, "X", "1002", 35.0, -119.0, "burn"),
        (9, 16, "F", "1002", 35.0, -119.0, "cold"), (10, 16, "F", "1002", 35.0, -119.0, "burn"),
    ]
    return spark.createDataFrame(
        rows, "id long, age int, sex string, zip string, lat double, lon double, disease string")


@pytest.fixture
def mixed(spark):
    rows = [
        (1, 1, 1.0, "a", 7.0), (2, None, 2.0, "b", 7.0), (3, 3, None, "b", 7.0), (4, 4, float("nan"), None, 7.0),
        (5, 4, 10.0, "a", None), (6, 6, 2.0, "c", 7.0),
    ]
    return spark.createDataFrame(rows, "id long, a int, b double, c string, `odd name (x)\t` double")
