"""Order amounts, and sales by province and product."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gmv_total(orders: DataFrame, day: str) -> DataFrame:
    """Order amount of a day; NULL when nothing was ordered."""
    return orders.filter(F.col("create_date") == day).agg(F.sum("total_amount").alias("amount"))


def gmv_by_hour(orders: DataFrame, day: str) -> DataFrame:
    day_orders = orders.filter(F.col("create_date") == day)
    return day_orders.groupBy(F.col("create_hour").alias("hour")).agg(
        F.sum("total_amount").cast("double").alias("amount")
    )


def sales_by_province(orders: DataFrame, bin_width: float = 100.0, bins: int = 6) -> DataFrame:
    """Orders and amount per province. ``bin`` is the map colour class of the
    order count: ``bin_width`` wide, the last one open."""
    totals = orders.groupBy("province_id").agg(
        F.count("*").alias("orders"), F.sum("total_amount").alias("amount")
    )
    step = F.floor(F.col("orders") / F.lit(bin_width)).cast("int")
    return totals.withColumn("bin", F.least(step, F.lit(bins - 1)))


def sales_by_sku(sales: DataFrame) -> DataFrame:
    """``(name, num)``: sold details per product name, most sold first."""
    counts = sales.groupBy(F.col("sku_name").alias("name")).agg(F.count("*").alias("num"))
    return counts.orderBy(F.desc("num"), "name")
