"""Orders and details that wait for each other in tables instead of in the state of a stream.

What a batch brings meets what has waited, in plain joins of the batch, so Spark splits
an order with very many details like any other skewed key. Rows wait in slots of their
time of arrival, and a batch opens the slots that its rows can reach. How far both
topics have come is kept per batch; once a slot can meet nothing new any more, its rows
without a partner come out.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import schemas
from ..operators.joins import within_wait
from . import sinks

SLOT_MS = 60_000
NAMED_SLOTS = 2_000  # that are opened by name; a wider range is a filter over all slots
SLOT, ARRIVAL = "slot", "arrived"

_ORDERS = StructType([*schemas.ORDER_INFO.fields, StructField(ARRIVAL, LongType()), StructField(SLOT, LongType())])
_DETAILS = StructType([*schemas.DETAIL_WIRE.fields, StructField(ARRIVAL, LongType()), StructField(SLOT, LongType())])
_PROGRESS = StructType([StructField("orders", LongType()), StructField("details", LongType())])


class Room(NamedTuple):
    """``late_seconds`` is how far a record may be behind the topic that has come less far."""

    path: str
    wait_seconds: int = 100
    late_seconds: int = 900

    def place(self, name: str) -> str:
        return f"{self.path.rstrip('/')}_{name}"


class Progress(NamedTuple):
    """The newest times of arrival of both topics, in ms."""

    orders: int | None = None
    details: int | None = None

    def bound(self, room: Room) -> int | None:
        """Records that arrived earlier are late; none while a topic has brought nothing."""
        return None if None in self else min(self) - room.late_seconds * 1000

    def closed(self, room: Room) -> int | None:
        """The first slot whose rows can still meet new ones."""
        bound = self.bound(room)
        return None if bound is None else (bound - room.wait_seconds * 1000) // SLOT_MS


def create(spark: SparkSession, room: Room) -> None:
    sinks.create_table(spark, room.place("orders"), _ORDERS, (SLOT,))
    sinks.create_table(spark, room.place("details"), _DETAILS, (SLOT,))


def _slots(spark: SparkSession, path: str, schema: StructType, first: int, last: int) -> DataFrame:
    """Rows of the slots from ``first`` to ``last``."""
    if last < first:
        return spark.createDataFrame([], sinks.layout(schema))
    names = [str(s) for s in range(first, last + 1)] if last - first < NAMED_SLOTS else None
    found = sinks.read_versions(spark, path, schema, names and (SLOT, names))
    return found.filter(F.col(SLOT).between(first, last))


def _timed(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.timestamp_millis(ARRIVAL))


def _alone(rows: DataFrame, others: DataFrame, same: Column, room: Room) -> DataFrame:
    near = F.abs(F.col(f"x.{ARRIVAL}") - F.col(f"y.{ARRIVAL}")) <= room.wait_seconds * 1000
    return rows.alias("x").join(others.alias("y"), same & near, "left_anti")


def _told(rows: DataFrame, side: str, reason: str) -> DataFrame:
    order = F.col("id") if side == "order" else F.col("order_id")
    return rows.select(
        F.lit(side).alias("side"), "id", order.alias("order_id"), F.timestamp_millis(ARRIVAL).alias("received_at"), F.lit(reason).alias("reason"),
    )


def admit(orders: DataFrame, details: DataFrame, turn: sinks.Turn, room: Room) -> tuple[DataFrame, DataFrame]:
    """Let the rows of a batch in: ``(pairs, alone)``.

    ``orders`` and ``details`` are persisted and have ``received_at``. ``pairs`` are as
    ``joins.within_wait`` makes them. ``alone`` has the rows ``(side, id, order_id,
    received_at, reason)`` that found no partner in their wait (``expired``), and those
    that came too late to be let in (``late``). Letting a batch in again gives the
    same. Records without a time of arrival are late.
    """
    spark = orders.sparkSession
    seen = Progress(*(sinks.recall(spark, turn, room.place("progress"), _PROGRESS) or ()))
    bound = seen.bound(room)
    place = lambda rows: rows.withColumn(ARRIVAL, F.unix_millis("received_at")).withColumn(SLOT, F.call_function("div", ARRIVAL, F.lit(SLOT_MS))).drop("received_at")
    punctual = F.col(ARRIVAL).isNotNull() if bound is None else F.coalesce(F.col(ARRIVAL) >= bound, F.lit(False))
    o, d = place(orders), place(details)
    late = _told(o.filter(~punctual), "order", "late").unionByName(_told(d.filter(~punctual), "detail", "late"))
    o, d = o.filter(punctual), d.filter(punctual)
    span = o.select(ARRIVAL).unionByName(d.select(ARRIVAL)).agg(F.min(ARRIVAL), F.max(ARRIVAL)).first()
    newest = [f.agg(F.max(ARRIVAL)).first()[0] for f in (o, d)]
    now = Progress(*[max((x for x in pair if x is not None), default=None) for pair in zip(seen, newest, strict=True)])

    wait = room.wait_seconds * 1000
    reach = (0, -1) if span[0] is None else ((span[0] - wait) // SLOT_MS, (span[1] + wait) // SLOT_MS)
    waited = lambda name, schema, first, last: _slots(spark, room.place(name), schema, first, last).filter(sinks.before(turn)).drop(*sinks.VERSION)
    old_o, old_d = waited("orders", _ORDERS, *reach), waited("details", _DETAILS, *reach)
    timed_o, timed_d = _timed(o, "order_ts"), _timed(d, "detail_ts")
    pairs = within_wait(timed_o.unionByName(_timed(old_o, "order_ts")), timed_d, room.wait_seconds).select("o.*", F.struct("d.*").alias("_d")).unionByName(
        within_wait(timed_o, _timed(old_d, "detail_ts"), room.wait_seconds).select("o.*", F.struct("d.*").alias("_d"))
    )
    pairs = pairs.select(F.struct(*[c for c in pairs.columns if c != "_d"]).alias("o"), F.col("_d").alias("d"))

    sinks.write_batch(o.select(*_ORDERS.fieldNames()), turn, room.place("orders"), (SLOT,))
    sinks.write_batch(d.select(*_DETAILS.fieldNames()), turn, room.place("details"), (SLOT,))
    sinks.remember(spark, turn, room.place("progress"), _PROGRESS, tuple(now))

    first, last = seen.closed(room), now.closed(room)
    if last is None or last == first:
        return pairs, late
    if first is None:
        earliest = sinks.read_versions(spark, room.place("orders"), _ORDERS).select(SLOT).unionByName(
            sinks.read_versions(spark, room.place("details"), _DETAILS).select(SLOT)).agg(F.min(SLOT)).first()[0]
        first = last if earliest is None else earliest
    around = -(-wait // SLOT_MS)
    every = lambda name, schema, new, a, b: waited(name, schema, a, b).unionByName(new.filter(F.col(SLOT).between(a, b)).select(*schema.fieldNames()))
    same = lambda order, detail: F.col(f"{order}.id") == F.col(f"{detail}.order_id")
    lone_o = _alone(every("orders", _ORDERS, o, first, last - 1), every("details", _DETAILS, d, first - around, last - 1 + around), same("x", "y"), room)
    lone_d = _alone(every("details", _DETAILS, d, first, last - 1), every("orders", _ORDERS, o, first - around, last - 1 + around), same("y", "x"), room)
    return pairs, late.unionByName(_told(lone_o, "order", "expired")).unionByName(_told(lone_d, "detail", "expired"))
