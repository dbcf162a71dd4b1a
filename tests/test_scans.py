"""What reaches the scan: filters, partitions and columns."""

import pytest
from pyspark.sql import functions as F

from retailstream import schemas
from retailstream.catalog import QUERIES
from retailstream.plans import activity, revenue, sales
from retailstream.streaming import sinks

from .conftest import FOLDER


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dau_total", "dau_by_hour", "gmv_total", "gmv_by_hour", "sale_total"])
def test_day_bounds_reach_the_file(spark, name):
    assert "PushedFilters: [IsNotNull(" in plan(QUERIES[name](spark, FOLDER))
    assert "GreaterThanOrEqual(" in plan(QUERIES[name](spark, FOLDER))


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["gmv_by_hour"](spark, FOLDER))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_multiplies_tables(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text


@pytest.mark.parametrize("schema,day_column,report", [
    (schemas.STARTUP_LOG, "logDate", activity.dau_total),
    (schemas.STARTUP_LOG, "logDate", activity.dau_by_hour),
    (schemas.ORDER_INFO, "create_date", revenue.gmv_total),
    (schemas.ORDER_INFO, "create_date", revenue.gmv_by_hour),
    (schemas.SALE_DETAIL, "dt", sales.search),
])
def test_tables_are_pruned_by_day(spark, tmp_path, schema, day_column, report):
    path = str(tmp_path / "table")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != day_column]
    row = spark.range(1).select(*nothing, F.lit("2024-01-15").alias(day_column))
    sinks.write_batch(row, 0, path, (day_column,))
    for table in (
        sinks.read_versions(spark, path, schema),
        sinks.read_latest(spark, path, schema, [schema[0].name], (day_column,)),
    ):
        assert f"PartitionFilters: [isnotnull({day_column}" in plan(report(table, "2024-01-15"))
