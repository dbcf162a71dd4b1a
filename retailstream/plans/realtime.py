"""Headline figures and the hour-by-hour comparison with the day before."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .activity import dau_total, new_devices
from .revenue import gmv_total

# Metric ids and the names shown with them.
METRICS = {
    "dau": "新增日活",
    "new_mid": "新增设备",
    "order_amount": "新增交易额",
}


def _today(frame: DataFrame) -> str:
    """The current day of the session, whose time zone also cuts the days of records."""
    return frame.sparkSession.range(1).select(F.current_date()).first()[0].isoformat()


def _day_before(day: str) -> str:
    return (date.fromisoformat(day) - timedelta(days=1)).isoformat()


def realtime_total(dau: DataFrame, orders: DataFrame, logs: DataFrame | None = None, day: str | None = None,
                   new: DataFrame | None = None) -> DataFrame:
    """``(id, name, value)`` for active devices, new devices and order amount.

    ``new`` has the new devices by day, as ``jobs.read_new_devices`` gives them; only
    the day is read then. Otherwise they are looked for in ``logs``, all activity up
    to the day, or else in the DAU table, which has a row for every device and day.
    """
    day = day or _today(dau)
    new = new_devices(dau if logs is None else logs, day) if new is None else new
    figures = {
        "dau": dau_total(dau, day).select(F.col("total").cast("double").alias("value")),
        "new_mid": dau_total(new, day).select(F.col("total").cast("double").alias("value")),
        "order_amount": gmv_total(orders, day).select(F.col("amount").alias("value")),
    }
    rows = [
        figure.select(F.lit(metric).alias("id"), F.lit(METRICS[metric]).alias("name"), "value")
        for metric, figure in figures.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def total_json(figures: DataFrame) -> DataFrame:
    """The three figures as one JSON list; a figure without a value has none."""
    position = F.array_position(F.lit(list(METRICS)), F.col("id"))
    entries = F.array_sort(F.collect_list(F.struct(position.alias("at"), F.struct("id", "name", "value").alias("entry"))))
    return figures.agg(F.to_json(entries["entry"]).alias("report"))


def _compare(facts: DataFrame, day_column: str, hour_column: str, value: Column, day: str) -> DataFrame:
    """``(hour, yesterday, today)`` summed in one pass over both days; a day
    without rows in an hour is NULL there."""
    yesterday = _day_before(day)
    both = facts.filter(F.col(day_column).isin(yesterday, day))
    of = lambda d: F.sum(F.when(F.col(day_column) == d, value))
    return both.groupBy(F.col(hour_column).alias("hour")).agg(
        of(yesterday).alias("yesterday"), of(day).alias("today")
    )


def hours_dau(dau: DataFrame, day: str) -> DataFrame:
    return _compare(dau, "logDate", "logHour", F.lit(1), day)


def hours_new_devices(logs: DataFrame, day: str) -> DataFrame:
    return hours_dau(new_devices(logs, day), day)


def hours_amount(orders: DataFrame, day: str) -> DataFrame:
    return _compare(orders, "create_date", "create_hour", F.col("total_amount"), day)


def realtime_hours(metric: str, dau: DataFrame, orders: DataFrame, logs: DataFrame | None = None,
                   day: str | None = None, new: DataFrame | None = None) -> DataFrame:
    """The comparison for one metric id; an unknown id has no rows. ``new`` as above."""
    day = day or _today(dau)
    if metric == "dau":
        return hours_dau(dau, day)
    if metric == "new_mid":
        return hours_new_devices(dau if logs is None else logs, day) if new is None else hours_dau(new, day)
    if metric == "order_amount":
        return hours_amount(orders, day)
    return hours_dau(dau, day).limit(0)


def every_hour(hours: DataFrame) -> DataFrame:
    """The hours 00 to 23, with 0 where a comparison has nothing. Whatever else a
    comparison has stays, so that the hours add up to the total."""
    spine = hours.sparkSession.range(24).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("hour"))
    zeros = spine.select("hour", *[F.lit(0).cast(t).alias(c) for c, t in hours.dtypes if c != "hour"])
    return hours.unionByName(zeros).groupBy("hour").agg(
        F.coalesce(F.sum("yesterday"), F.lit(0)).alias("yesterday"),
        F.coalesce(F.sum("today"), F.lit(0)).alias("today"),
    )


def hours_json(hours: DataFrame) -> DataFrame:
    """One row, one JSON object: hour-to-value maps for ``yesterday`` and ``today``.

    Takes a comparison, so at most a handful of rows per day come together.
    """
    def series(column):
        points = F.collect_list(F.when(F.col(column).isNotNull(), F.struct("hour", F.col(column).alias("value"))))
        return F.map_from_entries(F.array_sort(points)).alias(column)

    return hours.agg(series("yesterday"), series("today")).select(
        F.to_json(F.struct("yesterday", "today")).alias("report")
    )
