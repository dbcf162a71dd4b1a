"""Database change entries to topic records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DETAIL_TOPIC, ORDER_TOPIC, USER_TOPIC


def row_entries(entries: DataFrame) -> DataFrame:
    """Entries that carry rows; transaction marks and the like are dropped."""
    return entries.filter(F.col("entry_type") == "ROWDATA")


def cdc_topic(table_name="table_name", event_type="event_type") -> Column:
    """Topic of a change, NULL for changes nobody asked for.

    New orders, new order details, and new or changed users pass.
    """
    table, event = F.col(table_name), F.col(event_type)
    return (
        F.when((table == "order_info") & (event == "INSERT"), ORDER_TOPIC)
        .when((table == "order_detail") & (event == "INSERT"), DETAIL_TOPIC)
        .when((table == "user_info") & event.isin("INSERT", "UPDATE"), USER_TOPIC)
    )


def route_cdc(entries: DataFrame) -> DataFrame:
    """Row entries with their ``topic``; the rest is dropped before any row is unpacked."""
    return row_entries(entries).withColumn("topic", cdc_topic()).filter(F.col("topic").isNotNull())


def last_of_each(entries: Column, name: str) -> Column:
    """Of structs with the same ``name`` the last one; those without a name are left out.

    Nearly all records are fine already, which a look at the names tells.
    """
    names = entries[name]
    fine = F.size(F.array_distinct(F.array_compact(names))) == F.size(names)
    last = F.filter(
        entries, lambda e, i: e[name].isNotNull() & ~F.array_contains(F.array_compact(F.slice(names, i + 2, F.size(names))), e[name])
    )
    return F.when(fine, entries).otherwise(last)


def flatten_cdc(routed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One flat JSON object of strings per changed row, and its ``position`` among
    the rows of the entry. Of a repeated column the last value counts; columns
    without a name are left out."""
    rows = routed.select("topic", *keep, F.posexplode("rows").alias("position", "row"))
    fields = F.map_from_entries(last_of_each(F.col("row"), "name"))
    return rows.select("topic", *keep, "position", F.to_json(fields).alias("value"))
