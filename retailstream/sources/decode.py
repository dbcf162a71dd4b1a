"""JSON text to typed records.

A record that is no JSON object, or lacks a field the job cannot do without,
keeps its text in ``_rejected`` instead of failing the batch. ``accepted`` and
``rejected`` split the result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..functions.clock import is_sane, text_day, text_hour, with_log_time
from ..functions.values import as_price, masked_phone

REJECTED = "_rejected"


def decode(raw: DataFrame, schema: StructType, required: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse ``raw.value`` with ``schema``; ``keep`` names columns to carry along."""
    layout = StructType(schema.fields + [StructField(REJECTED, StringType())])
    parsed = F.from_json("value", layout, {"columnNameOfCorruptRecord": REJECTED})
    # A one-element inline() instead of a plain select: filters on the fields
    # then stay above it, so the text is parsed once per record, not twice.
    record = raw.select(*keep, "value", F.inline(F.array(parsed)))
    broken = F.col(REJECTED).isNotNull()
    for name in required:
        broken = broken | F.col(name).isNull()
    if "ts" in required:
        broken = broken | ~is_sane("ts")
    return record.select(
        *keep, *schema.fieldNames(), F.when(broken, F.coalesce("value", F.lit(""))).alias(REJECTED)
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(REJECTED).isNull()).drop(REJECTED)


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(REJECTED).isNotNull()).select(F.col(REJECTED).alias("value"))


def counted(decoded: DataFrame, name: str) -> DataFrame:
    """Report ``records`` and ``rejected`` as observed metrics; on a stream they
    come with the progress of every batch."""
    return decoded.observe(
        name, F.count("*").alias("records"), F.count_if(F.col(REJECTED).isNotNull()).alias("rejected")
    )


def _in_order(frame: DataFrame, schema: StructType, keep: tuple[str, ...]) -> DataFrame:
    extra = [REJECTED] if REJECTED in frame.columns else []
    return frame.select(*schema.fieldNames(), *keep, *extra)


def startup_logs(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    decoded = decode(raw, schemas.STARTUP_WIRE, ("mid", "ts"), keep)
    return _in_order(_timed(decoded), schemas.STARTUP_LOG, keep)


def _timed(decoded: DataFrame) -> DataFrame:
    """Day and hour of records with a time that has them; others are rejected anyway."""
    return with_log_time(decoded.withColumn("ts", F.when(is_sane("ts"), F.col("ts"))))


def event_logs(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Page and item numbers may arrive as JSON numbers; they become text."""
    decoded = decode(raw, schemas.EVENT_WIRE, ("mid", "evid", "ts"), keep)
    return _in_order(_timed(decoded), schemas.EVENT_LOG, keep)


def typed_orders(orders: DataFrame) -> DataFrame:
    """Number, date and hour columns and the masked phone, from all-text orders."""
    return orders.withColumns(
        {
            "total_amount": as_price("total_amount"),
            "create_date": text_day(F.col("create_time")),
            "create_hour": text_hour(F.col("create_time")),
            "consignee_tel": masked_phone("consignee_tel"),
        }
    )


def order_infos(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    decoded = decode(raw, schemas.ORDER_WIRE, ("id", "create_time"), keep)
    no_hour = text_hour(F.col("create_time")).isNull() & F.col(REJECTED).isNull()
    marked = decoded.withColumn(
        REJECTED, F.when(no_hour, F.to_json(F.struct(*schemas.ORDER_WIRE.fieldNames()))).otherwise(F.col(REJECTED))
    )
    return _in_order(typed_orders(marked), schemas.ORDER_INFO, keep)


def order_details(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _in_order(decode(raw, schemas.DETAIL_WIRE, ("id", "order_id"), keep), schemas.DETAIL_WIRE, keep)


def cdc_entries(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Change entries that arrive as JSON text."""
    return decode(raw, schemas.CDC_ENTRY, ("entry_type",), keep)


def user_infos(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _in_order(decode(raw, schemas.USER_WIRE, ("id",), keep), schemas.USER_WIRE, keep)
