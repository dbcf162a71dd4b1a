"""First activity per device and day, and the latest row per key.

Both keep one row per group through a ranking filter. Spark ranks inside every
map task first and ships one row per group and task, so a device or key with a
third of all rows costs no more than any other.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import day_of


def _best(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ranked = frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def first_activity(logs: DataFrame) -> DataFrame:
    """Earliest record of each device on each day.

    Records of the same millisecond are told apart by account, then by their
    other columns, so the choice does not depend on the order of arrival.
    """
    others = [c for c in logs.columns if c not in ("mid", "logDate", "ts", "uid")]
    return _best(logs, ["logDate", "mid"], [F.col(c).asc() for c in ("ts", "uid", *others)])


def first_activity_time(logs: DataFrame) -> DataFrame:
    """Just ``(logDate, mid, ts)`` of the earliest records, for the counts.

    A minimum over a number needs no sort, so reports use this one.
    """
    return logs.groupBy("logDate", "mid").agg(F.min("ts").alias("ts"))


def first_ever(logs: DataFrame, known: DataFrame) -> DataFrame:
    """``(mid, ts, gone, logDate)`` to add to ``known`` (rows alike) for new records.

    A device that is not known gets a row in the day of its first record. If an
    earlier record of a known one comes late, a row in the earlier day is added, and
    one that takes the device out of the day it had. So each day's rows tell on
    their own who was new, and adding the same records again changes nothing.
    """
    first = logs.groupBy("mid").agg(F.min("ts").alias("ts"))
    # Only devices that occur go into the minimum. Rows of days given up are later ones.
    had = known.join(first.select("mid"), "mid", "left_semi").groupBy("mid").agg(F.min("ts").alias("had"))
    moved = first.join(had, "mid", "left").filter("had is null or ts < had")
    left = moved.filter(day_of("ts") != day_of("had")).select("mid", F.col("had").alias("ts"), F.lit(True).alias("gone"))
    return moved.select("mid", "ts", F.lit(False).alias("gone")).unionByName(left).withColumn("logDate", day_of("ts"))


def unseen(logs: DataFrame, seen: DataFrame) -> DataFrame:
    """Records whose device is not yet in ``seen`` for the day of the record."""
    return logs.join(seen.select("logDate", "mid").distinct(), ["logDate", "mid"], "left_anti")


def new_activity(logs: DataFrame, seen: DataFrame) -> DataFrame:
    """First record per device and day among devices not seen before that day.

    Ranking first leaves one row per device and day for the anti join, so no
    busy device can weigh on it; the result is the same either way round.
    """
    return unseen(first_activity(logs), seen).select(*logs.columns)


def latest_per_key(frame: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The row with the highest ``newest`` columns per key; last write wins.

    Remaining ties fall to the other columns, so repeated runs agree.
    """
    others = [c for c, t in frame.dtypes if c not in (*keys, *newest) and not t.startswith(("map", "variant"))]
    order = [F.col(c).desc_nulls_last() for c in (*newest, *others)]
    return _best(frame, keys, order)
