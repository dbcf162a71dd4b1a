"""Sums that follow changes: a changed row takes its old part back and adds its new one.

A report over a day then reads that day alone, though rows can move between days:
the day that a row has left holds the row with a minus.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sums of decimals do not depend on their order, so taking back leaves nothing over.
AMOUNT = "decimal(38,6)"


def signed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of ``new`` with ``sign`` 1 and those of ``old``, the versions they replace, with -1."""
    plus, minus = F.lit(1).cast("bigint"), F.lit(-1).cast("bigint")
    columns = old.columns
    return new.select(*columns).withColumn("sign", plus).unionByName(old.withColumn("sign", minus))


def signed_versions(versions: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """The same from the whole history of each ``key``: each version with 1, and with -1 unless it is the last."""
    line = Window.partitionBy(key).orderBy(*[F.col(c) for c in newest])
    following = versions.withColumn("_last", F.lead(F.lit(True)).over(line).isNull())
    plus, minus = F.lit(1).cast("bigint"), F.lit(-1).cast("bigint")
    signs = F.when(F.col("_last"), F.array(plus)).otherwise(F.array(plus, minus))
    return following.withColumn("sign", F.explode(signs)).drop("_last")


def amount_of(column: str) -> Column:
    return F.col(column).try_cast(AMOUNT)


def hourly(changes: DataFrame, day: str = "create_date", hour: str = "create_hour", amount: str = "total_amount") -> DataFrame:
    """``(day, hour, orders, total_amount)``: what the changes add to each hour; hours that they leave as they were are left out."""
    sums = changes.groupBy(day, hour).agg(
        F.sum("sign").alias("orders"), F.coalesce(F.sum(F.col("sign") * amount_of(amount)), F.lit(0)).cast(AMOUNT).alias(amount)
    )
    return sums.filter((F.col("orders") != 0) | (F.col(amount) != 0))


def totals(hours: DataFrame, day: str = "create_date", hour: str = "create_hour", amount: str = "total_amount") -> DataFrame:
    """Changes of hours added up: ``(day, hour, orders, total_amount)`` with amounts as doubles.

    The result is a frame that the reports of order amounts take in place of orders.
    """
    sums = hours.groupBy(day, hour).agg(F.sum("orders").alias("orders"), F.sum(amount).cast("double").alias(amount))
    return sums.filter(F.col("orders") != 0)
