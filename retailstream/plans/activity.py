"""Active and new devices."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import day_of, hour_of


def dau_total(dau: DataFrame, day: str) -> DataFrame:
    """Number of devices active on ``day``; ``dau`` has one row per device and day."""
    return dau.filter(F.col("logDate") == day).agg(F.count("*").alias("total"))


def dau_by_hour(dau: DataFrame, day: str) -> DataFrame:
    """Devices by the hour they were first seen that day."""
    hours = dau.filter(F.col("logDate") == day)
    return hours.groupBy(F.col("logHour").alias("hour")).agg(F.count("*").alias("total"))


def new_devices(logs: DataFrame, upto: str | None = None) -> DataFrame:
    """``(mid, logDate, logHour)`` of the first record each device ever sent.

    Later days than ``upto`` can't change who is new on it, so they are not read.
    """
    first = (logs if upto is None else logs.filter(F.col("logDate") <= upto)).groupBy("mid").agg(F.min("ts").alias("ts"))
    return first.select("mid", day_of("ts").alias("logDate"), hour_of("ts").alias("logHour"))


def first_seen(rows: DataFrame) -> DataFrame:
    """``(mid, logDate, logHour)`` of new devices, from rows as ``dedup.first_ever`` makes
    them. The days decide on their own, so a filter on ``logDate`` reaches the scan."""
    found = rows.groupBy("logDate", "mid").agg(F.min("ts").alias("ts"), F.max("gone").alias("gone"))
    return found.filter(~F.col("gone")).select("mid", "logDate", hour_of("ts").alias("logHour"))
