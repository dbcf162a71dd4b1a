"""Every query gives what its SQL gives on the same tables."""

import pytest

import __spark_entry__ as spark_entry
from retailstream.catalog import QUERIES
from retailstream.oracle import ORACLE_SQL

from .check import connect, differences
from .conftest import FOLDER

# The smallest sample has no new devices on the second day and no orders on ORDER_DAY.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert QUERIES.items() <= spark_entry.queries().items() and ORACLE_SQL.items() <= spark_entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLE_SQL[name]) is None


def test_new_devices_and_sides_occur(spark):
    """Results of nothing but zeros would agree with any SQL."""
    assert QUERIES["hours_new_device"](spark, LARGER).agg({"today": "sum"}).first()[0] > 0
    assert all(r.value > 0 for r in QUERIES["realtime_total"](spark, LARGER).collect())
    assert {r.side for r in QUERIES["order_detail_audit"](spark, LARGER).collect()} == {"both", "order", "detail"}


def test_hours_add_up_to_the_total(spark):
    hours = QUERIES["hours_gmv_unpadded"](spark, LARGER).agg({"today": "sum"}).first()[0]
    assert hours == pytest.approx(QUERIES["gmv_total"](spark, LARGER).first().amount)


def test_entry(spark):
    frame = spark_entry.entry(spark)
    assert frame.columns == ["title", "name", "value"]
    assert frame.count() == 5


def test_the_session_keeps_its_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        frame = QUERIES["hours_dau"](spark, FOLDER)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Shanghai"
        assert differences(frame, connect(FOLDER), ORACLE_SQL["hours_dau"]) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
