"""App logs as they arrive: receive time stamped, then sorted into topics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVENT_TOPIC, STARTUP_TOPIC
from .cdc import last_of_each
from .decode import REJECTED


def stamp_receive_time(raw: DataFrame, received_at: Column) -> DataFrame:
    """Set ``ts`` in every record to the receive time, in place of any sent value.

    All other fields, known or not, keep their JSON types; of a repeated field the
    last value counts. Text that is no JSON object goes to ``_rejected`` and leaves
    ``value`` NULL.
    """
    fields = F.map_entries(F.from_json("value", "map<string,variant>"))
    sent = last_of_each(F.filter(fields, lambda f: f["key"] != F.lit("ts")), "key")
    stamp = F.array(F.struct(F.lit("ts").alias("key"), F.unix_millis(received_at).cast("variant").alias("value")))
    stamped = F.to_json(F.map_from_entries(F.concat(sent, stamp)))
    others = [c for c in raw.columns if c != "value"]
    return raw.select(
        *others, F.col("value").alias("_sent"), F.inline(F.array(F.struct(stamped.alias("value"))))
    ).select(
        *others, "value", F.when(F.col("value").isNull(), F.coalesce("_sent", F.lit(""))).alias(REJECTED)
    )


def log_topic(value) -> Column:
    """``startup`` records go to one topic, all others (no type included) to the other."""
    is_startup = F.get_json_object(value, "$.type").eqNullSafe(F.lit("startup"))
    return F.when(is_startup, STARTUP_TOPIC).otherwise(EVENT_TOPIC)


def route_logs(stamped: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(topic, value)`` of every well-formed log record."""
    return stamped.filter(F.col(REJECTED).isNull()).select(log_topic("value").alias("topic"), "value", *keep)


def raw_archive(stamped: DataFrame, received_at: Column) -> DataFrame:
    """Every well-formed record with the day it came in, for the daily archive."""
    return stamped.filter(F.col(REJECTED).isNull()).select("value", F.to_date(received_at).cast("string").alias("dt"))
