"""The continuous jobs. Each takes raw records (``value`` and, where time of
arrival matters, ``received_at``) and returns the running query.

The transformations are those of the batch reports; what is added here are
watermarks, sinks and checkpoints. Records that cannot be decoded, or lack what a
job needs, go to a table of their own beside the job's: ``<table>_rejected``.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from .. import schemas
from ..operators import changes, coupons, joins
from ..operators.dedup import first_ever, latest_per_key
from ..plans import activity
from ..schemas import SALE_DETAIL
from ..session import shared_folder
from ..sources import cdc, decode, logs
from ..sources.topics import ARRIVAL
from . import keyed, search, sinks, waiting

EVERY = "5 seconds"
USER_EVERY = "3 seconds"
NEW_EVERY = "1 minute"
# How far behind the newest records others may be and still count: after an outage
# the partitions of a topic catch up unevenly.
LATE = "15 minutes"


def start(
    frame: DataFrame,
    write: Callable[[DataFrame, sinks.Turn], None],
    name: str,
    checkpoint: str | None = None,
    every: str | None = EVERY,
) -> StreamingQuery:
    """Run ``write`` on every micro-batch. ``every=None`` takes what is there and stops.

    Progress is kept under the shared checkpoint folder unless told otherwise.
    """
    where = checkpoint or f"{shared_folder(frame.sparkSession)}/streams/{name}"
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = frame.writeStream.queryName(name).option("checkpointLocation", where).trigger(**trigger)
    run, begun = sinks.run_of(frame.sparkSession, where), []

    def each(batch, number):
        write(batch, sinks.Turn(run, number, not begun))
        begun.append(number)

    return writer.foreachBatch(each).start()


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came too late for a stateful job, over the progress it still holds."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def _arrival(raw: DataFrame) -> tuple[str, ...]:
    """Columns that tell which of two versions of a row came later."""
    return tuple(c for c in ARRIVAL if c in raw.columns)


def _sorting_out(write: Callable[[DataFrame, sinks.Turn], None], path: str) -> Callable[[DataFrame, sinks.Turn], None]:
    """``write`` for accepted records; rejected ones are kept in the same batch."""

    def both(batch, turn):
        kept = batch.persist()
        try:
            sinks.write_batch(decode.rejected(kept), turn, f"{path.rstrip('/')}_rejected", file_format="text")
            write(decode.accepted(kept), turn)
        finally:
            kept.unpersist()

    return both


def _keep_rejected(decoded: DataFrame, path: str, name: str, checkpoint: str | None, every: str | None) -> StreamingQuery:
    """A query of its own for the rejected records of a job that keeps state.

    One that an earlier start of the job has left running gives way to it.
    """
    beside = f"{checkpoint.rstrip('/')}_rejected" if checkpoint else None
    for running in decoded.sparkSession.streams.active:
        if running.name == f"{name}_rejected":
            running.stop()
    query = quarantine(decoded, f"{path.rstrip('/')}_rejected", f"{name}_rejected", beside, every)
    if every is None:
        query.awaitTermination()
    return query


def daily_active_devices(
    raw: DataFrame,
    path: str,
    checkpoint: str | None = None,
    every: str | None = EVERY,
    remember: str = "table",
    late: str = "2 days",
    salts: int = 16,
):
    """First activity per device and day into the DAU table.

    With ``remember='table'`` a batch is compared with the table's partitions
    of its days, and of several records in a batch the earliest is kept. With
    ``remember='state'`` the stream itself remembers the devices of a day until
    a day comes that begins ``late`` after its end, for days with so many of them
    that reading the table in every batch takes too long. Which of several records
    of one batch stays is then up to Spark; the records of a forgotten day are
    dropped (``dropped_late`` counts them), never repeated. The state forgets repeats in
    two steps: by device, day and one of ``salts`` parts by the hash of the record,
    then by device and day, where a device has a row per part at most, however busy
    it is.
    """
    if remember not in ("table", "state"):
        raise ValueError("remember devices in the 'table' or in the 'state'")
    schema = schemas.STARTUP_LOG
    sinks.create_table(raw.sparkSession, path, schema, ("logDate",))
    decoded = decode.counted(decode.startup_logs(raw), "startup_logs")
    if remember == "table":
        write = lambda batch, turn: sinks.add_new_activity(batch, turn, path, schema)
        return start(decoded, _sorting_out(write, path), "daily_active_devices", checkpoint, every)
    day_end = F.date_add(F.to_date("logDate"), 1).cast("timestamp")
    timed = decode.accepted(decoded).withColumn("day_end", day_end).withWatermark("day_end", late)
    salted = timed.withColumn("_salt", F.pmod(F.xxhash64("ts", "uid"), F.lit(salts)))
    thinned = salted.dropDuplicates(["mid", "logDate", "day_end", "_salt"]).drop("_salt")
    fresh = thinned.dropDuplicates(["mid", "logDate", "day_end"]).drop("day_end")
    write = lambda batch, turn: sinks.write_batch(batch, turn, path, ("logDate",))
    _keep_rejected(decode.startup_logs(raw), path, "daily_active_devices", checkpoint, every)
    return start(fresh, write, "daily_active_devices", checkpoint, every)


def _first_seen(path: str) -> keyed.Keyed:
    return keyed.Keyed(f"{path.rstrip('/')}_first", schemas.FIRST_TIME, ("mid",))


def new_devices(raw: DataFrame, path: str, checkpoint: str | None = None, every: str | None = NEW_EVERY):
    """The first record ever of each device into a table by day.

    When a device was first seen is looked up by buckets of its id, and the reports
    read just the days they show (``read_new_devices``), so neither goes back to the log.
    """
    sinks.create_table(raw.sparkSession, path, schemas.FIRST_SEEN, ("logDate",))
    decoded = decode.counted(decode.startup_logs(raw), "startup_logs")

    def write(batch, turn):
        first = batch.groupBy("mid").agg(F.min("ts").alias("ts")).persist()
        try:
            known = keyed.lookup(first, _first_seen(path), turn)
            rows = first_ever(first, known).persist()
            try:
                sinks.write_batch(rows, turn, path, ("logDate",))
                keyed.upsert(rows.filter(~F.col("gone")), turn, _first_seen(path))
            finally:
                rows.unpersist()
        finally:
            first.unpersist()

    return start(decoded, _sorting_out(write, path), "new_devices", checkpoint, every)


def read_new_devices(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """``(mid, logDate, logHour)`` of new devices, from the partitions of the ``days`` alone."""
    kept = sinks.read_versions(spark, path, schemas.FIRST_SEEN, None if days is None else ("logDate", days))
    return activity.first_seen(kept)


def _order_places(path: str) -> keyed.Keyed:
    return keyed.Keyed(f"{path.rstrip('/')}_places", schemas.ORDER_PLACE, ("id",))


def _order_hours(path: str) -> str:
    return f"{path.rstrip('/')}_hours"


def order_facts(raw: DataFrame, path: str, checkpoint: str | None = None, every: str | None = EVERY):
    """Orders with masked phones into the order table, the last version per id.

    Beside it, ``<path>_places`` keeps the day, hour and amount of each order, looked up
    by buckets of the id. From there a batch knows what its orders were before: an order
    that moves to another day leaves a row in the old one that takes it out, and
    ``<path>_hours`` gets what the batch adds to each hour, or takes from it. So
    readers of either open the days they ask for and no others.
    """
    spark, places, hours = raw.sparkSession, _order_places(path), _order_hours(path)
    sinks.create_table(spark, path, schemas.ORDER_VERSION, ("create_date",))
    sinks.create_table(spark, hours, schemas.ORDER_HOUR, ("create_date",))
    arrival = _arrival(raw)
    decoded = decode.counted(decode.order_infos(raw, arrival), "order_infos")
    columns = schemas.ORDER_VERSION.fieldNames()

    def write(batch, turn):
        latest = latest_per_key(batch, ["id"], list(arrival)).drop(*arrival).persist()
        try:
            had = keyed.lookup(latest, places, turn).persist()
            try:
                days = latest.select("id", F.col("create_date").alias("_day"))
                left = had.join(days, "id").filter(~F.col("create_date").eqNullSafe(F.col("_day"))).select("id", "create_date")
                stays = latest.withColumn("gone", F.lit(False))
                rows = stays.unionByName(left.withColumn("gone", F.lit(True)), allowMissingColumns=True).select(*columns)
                sinks.write_batch(rows, turn, path, ("create_date",))
                sums = changes.hourly(changes.signed(latest, had.select(*schemas.ORDER_PLACE.fieldNames())))
                sinks.write_batch(sums, turn, hours, ("create_date",))
                # Last, though the look-up leaves this batch out anyway: what is above can be done again.
                keyed.upsert(latest, turn, places)
            finally:
                had.unpersist()
        finally:
            latest.unpersist()

    return start(decoded, _sorting_out(write, path), "order_facts", checkpoint, every)


def read_orders(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """The last version of each order, from the partitions of the ``days`` alone: a day
    tells on its own which orders have left it."""
    found = sinks.read_latest(spark, path, schemas.ORDER_VERSION, ["id"], ("create_date",), days=days)
    return found.filter(~F.col("gone")).drop("gone")


def read_order_hours(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """``(create_date, create_hour, orders, total_amount)`` of the orders of ``path``: a few rows
    per batch and day, for reports of order amounts, which take them in place of orders."""
    only = None if days is None else ("create_date", days)
    return changes.totals(sinks.read_versions(spark, _order_hours(path), schemas.ORDER_HOUR, only))


def coupon_alerts(
    raw: DataFrame,
    path: str,
    panes_path: str,
    checkpoint: str | None = None,
    every: str | None = EVERY,
    late: str = LATE,
    window_seconds: int = coupons.WINDOW_SECONDS,
    slide_seconds: int = coupons.SLIDE_SECONDS,
    min_accounts: int = coupons.MIN_ACCOUNTS,
    click: str = coupons.CLICK,
):
    """Alerts into the alert table, one per device and minute, the last one kept.

    The stream's state holds open panes only. Panes close once no event later
    than ``late`` can still fall into them, and go to the pane table; windows
    that end up to the last closed pane are then final, and are judged by the
    batch functions on the panes of the batch and those of one window before. How
    far windows are judged is kept by batch, beside the pane table, so neither a
    restart nor a stream that was idle reads more than that.
    """
    coupons.check_window(window_seconds, slide_seconds)
    sinks.create_table(raw.sparkSession, path, schemas.COUPON_ALERT, ("dt",))
    sinks.create_table(raw.sparkSession, panes_path, schemas.COUPON_PANE, ("stretch",))
    events = decode.accepted(decode.counted(decode.event_logs(raw), "event_logs"))
    _keep_rejected(decode.event_logs(raw), path, "coupon_alerts", checkpoint, every)
    timed = events.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", late)
    slide_ms, window_ms = slide_seconds * 1000, window_seconds * 1000
    # Panes lie in stretches of window length, numbered, so those of a window are two or three.
    stretch = F.call_function("div", F.col("ts") - F.pmod("ts", F.lit(window_ms)), F.lit(window_ms))
    panes = coupons.counted_panes(timed, slide_seconds).withColumn("stretch", stretch)
    judged = StructType([StructField("upto", LongType())])
    judged_path = f"{panes_path.rstrip('/')}_judged"

    def write(batch, turn):
        session = batch.sparkSession
        closed = batch.persist()
        try:
            newest = closed.agg(F.max("ts").alias("ts")).first().ts
            # How far windows have been judged by the batches before.
            before = (sinks.recall(session, turn, judged_path, judged) or (None,))[0]
            if newest is not None:
                upto = newest + slide_ms
                sinks.write_batch(closed, turn, panes_path, ("stretch",))
                recent, ends = closed, F.col("window_end") <= upto
                if before is not None:
                    # Panes that close later begin later, so of earlier batches only the last window counts.
                    since = before + slide_ms - window_ms
                    names = [str(s) for s in range(since // window_ms, before // window_ms + 1)]
                    old = sinks.read_versions(session, panes_path, schemas.COUPON_PANE, ("stretch", names))
                    # Another run may have counted the same events: its panes are its own.
                    old = old.filter((F.col(sinks.RUN) == turn.run) & (F.col(sinks.BATCH) < turn.number) & (F.col("ts") >= since))
                    recent = closed.unionByName(old.drop(*sinks.VERSION))
                    ends = ends & (F.col("window_end") > before)
                alerts = coupons.alert_windows(recent, window_seconds, slide_seconds, min_accounts, click).filter(ends)
                documents = coupons.alert_documents(recent, coupons.latest_per_minute(alerts), window_seconds, slide_seconds)
                sinks.write_batch(documents, turn, path, ("dt",))
                before = upto
            sinks.remember(session, turn, judged_path, judged, (before,))
        finally:
            closed.unpersist()

    return start(panes, write, "coupon_alerts", checkpoint, every)


def read_alerts(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    return sinks.read_latest(spark, path, schemas.COUPON_ALERT, ["alert_id"], ("dt",), ("ts",), days)


def _users(path: str) -> keyed.Keyed:
    return keyed.Keyed(path, schemas.USER_WIRE, ("id",))


def user_dimension(raw: DataFrame, path: str, checkpoint: str | None = None, every: str | None = USER_EVERY):
    """New and changed users into the user table, the last version per id, by buckets of the id."""
    arrival = _arrival(raw)
    decoded = decode.counted(decode.user_infos(raw, arrival), "user_infos")

    def write(batch, turn):
        keyed.upsert(batch, turn, _users(path), arrival)

    return start(decoded, _sorting_out(write, path), "user_dimension", checkpoint, every)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return keyed.read(spark, _users(path))


def sale_details(
    raw_orders: DataFrame,
    raw_details: DataFrame,
    users_path: str,
    path: str,
    checkpoint: str | None = None,
    every: str | None = EVERY,
    wait_seconds: int = 100,
    late: str = LATE,
    parts: int = 1,
):
    """Orders joined to their details and buyers into the sale detail table.

    Buyers come from the table of ``user_dimension``, of which a batch opens the buckets
    of its buyers. Either side waits ``wait_seconds`` of arrival time for the other. Records more
    than ``late`` behind the newest of their topic are dropped; ``dropped_late``
    counts them. The words of the product names go to postings beside the table
    (``search``).
    """
    spark = raw_orders.sparkSession
    sinks.create_table(spark, path, SALE_DETAIL, ("dt",))
    search.create(spark, path)
    orders = decode.order_infos(raw_orders, ("received_at",))
    details = decode.order_details(raw_details, ("received_at",))
    bad = decode.rejected(orders).unionByName(decode.rejected(details)).withColumnRenamed("value", decode.REJECTED)
    _keep_rejected(bad, path, "sale_details", checkpoint, every)
    orders = decode.accepted(decode.counted(orders, "order_infos"))
    details = decode.accepted(decode.counted(details, "order_details"))
    pairs = joins.within_wait(
        orders.withColumnRenamed("received_at", "order_ts").withWatermark("order_ts", late),
        details.withColumnRenamed("received_at", "detail_ts").withWatermark("detail_ts", late),
        wait_seconds,
        parts=parts,
    )
    bought = _bought(pairs)

    def write(batch, turn):
        _write_sales(batch, turn, users_path, path)

    return start(bought, write, "sale_details", checkpoint, every)


def _bought(pairs: DataFrame) -> DataFrame:
    """What a sale detail takes from its order (``o``) and its detail (``d``)."""
    return pairs.select(
        F.col("d.id").alias("order_detail_id"),
        F.col("o.id").alias("order_id"),
        "o.order_status",
        "o.create_time",
        "o.user_id",
        "d.sku_id",
        decode.as_price("d.order_price").alias("sku_price"),
        "d.sku_name",
        F.col("o.create_date").alias("dt"),
    )


def _write_sales(bought: DataFrame, turn: sinks.Turn, users_path: str, path: str) -> None:
    latest = latest_per_key(bought, ["order_detail_id"], ["create_time"]).persist()
    try:
        users = keyed.lookup(latest.select(F.col("user_id").alias("id")), _users(users_path))
        wide = joins.with_user(latest, users, F.current_timestamp(), "order_detail_id")
        sinks.write_batch(wide.select(*SALE_DETAIL.fieldNames()), turn, path, ("dt",))
        search.add_postings(latest, turn, path)
    finally:
        latest.unpersist()


def sale_details_from_rooms(
    raw_orders: DataFrame,
    raw_details: DataFrame,
    users_path: str,
    path: str,
    checkpoint: str | None = None,
    every: str | None = EVERY,
    wait_seconds: int = 100,
    late_seconds: int = 900,
):
    """The same table without state in the stream: what has no partner yet waits in tables.

    Spark splits orders with very many details by itself here. Rows that found no partner
    go to ``<path>_alone`` when their wait is over, and so do those that came more
    than ``late_seconds`` behind the slower topic; so what went in is either sold or
    told (``waiting.admit``).
    """
    spark = raw_orders.sparkSession
    room = waiting.Room(f"{path.rstrip('/')}_room", wait_seconds, late_seconds)
    sinks.create_table(spark, path, SALE_DETAIL, ("dt",))
    search.create(spark, path)
    waiting.create(spark, room)
    kind = lambda raw, name: raw.select("value", "received_at", F.lit(name).alias("kind"))
    both = kind(raw_orders, "order").unionByName(kind(raw_details, "detail"))

    def write(batch, turn):
        kept = batch.persist()
        of = lambda name: kept.filter(F.col("kind") == name).select("value", "received_at")
        orders = decode.order_infos(of("order"), ("received_at",)).persist()
        details = decode.order_details(of("detail"), ("received_at",)).persist()
        try:
            bad = decode.rejected(orders).unionByName(decode.rejected(details))
            sinks.write_batch(bad, turn, f"{path.rstrip('/')}_rejected", file_format="text")
            pairs, alone = waiting.admit(decode.accepted(orders), decode.accepted(details), turn, room)
            _write_sales(_bought(pairs), turn, users_path, path)
            sinks.write_batch(alone, turn, f"{path.rstrip('/')}_alone")
        finally:
            for frame in (details, orders, kept):
                frame.unpersist()

    return start(both, write, "sale_details_from_rooms", checkpoint, every)


def read_sales(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    return sinks.read_latest(spark, path, SALE_DETAIL, ["order_detail_id"], ("dt",), days=days)


def log_routing(
    raw: DataFrame,
    topics_path: str | None,
    archive_path: str,
    checkpoint: str | None = None,
    every: str | None = EVERY,
    sink: Callable[[DataFrame, sinks.Turn], None] | None = None,
):
    """Stamp logs with their arrival, archive them by day, and sort them into topics.

    Topics are tables at ``topics_path`` unless ``sink`` takes the routed records,
    as ``sinks.kafka_topics`` does.
    """
    publish = sink or sinks.topic_table_sink(topics_path)
    carried = ("received_at", *[c for c in ("offset",) if c in raw.columns])

    def write(batch, turn):
        stamped = logs.stamp_receive_time(batch, F.col("received_at")).persist()
        try:
            sinks.write_batch(decode.rejected(stamped), turn, f"{archive_path.rstrip('/')}_rejected", file_format="text")
            archive = logs.raw_archive(stamped, F.col("received_at"))
            sinks.write_batch(archive, turn, archive_path, ("dt",), "text")
            publish(logs.route_logs(stamped, carried), turn)
        finally:
            stamped.unpersist()

    return start(raw.select("value", *carried), write, "log_routing", checkpoint, every)


def cdc_routing(
    raw: DataFrame,
    topics_path: str,
    checkpoint: str | None = None,
    every: str | None = EVERY,
    sink: Callable[[DataFrame, sinks.Turn], None] | None = None,
):
    """Database change entries, as JSON text, into topics.

    What tells the order of changes goes with them: the entry's own time, its
    offset (or else its place in the micro-batch), and the row's place in the entry.
    """
    publish = sink or sinks.topic_table_sink(topics_path)

    def write(batch, turn):
        placed = batch if "offset" in batch.columns else batch.withColumn("offset", F.monotonically_increasing_id())
        decoded = decode.cdc_entries(placed, ("received_at", "offset")).persist()
        try:
            sinks.write_batch(decode.rejected(decoded), turn, f"{topics_path.rstrip('/')}_rejected", file_format="text")
            entries = cdc.route_cdc(decode.accepted(decoded)).withColumnRenamed("ts", "changed_at")
            publish(cdc.flatten_cdc(entries, ("received_at", "changed_at", "offset")), turn)
        finally:
            decoded.unpersist()

    return start(raw, write, "cdc_routing", checkpoint, every)


def quarantine(decoded: DataFrame, path: str, name: str, checkpoint: str | None = None, every: str | None = EVERY):
    """Keep the text of rejected records for a look by hand."""

    def write(batch, turn):
        sinks.write_batch(batch, turn, path, file_format="text")

    return start(decode.rejected(decoded), write, name, checkpoint, every)


def _committed(routed: DataFrame, path: str, name: str, checkpoint: str | None, every: str | None) -> StreamingQuery:
    """Routed records into topic tables by Spark's own file sink, which commits a batch as a whole."""
    where = checkpoint or f"{shared_folder(routed.sparkSession)}/streams/{name}"
    trigger = {"processingTime": every} if every else {"availableNow": True}
    none = {"changed_at": "bigint", "offset": "bigint", "position": "int"}
    full = routed.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in routed.columns})
    writer = full.select("value", "received_at", *none, "topic").writeStream.format("parquet").partitionBy("topic")
    return writer.queryName(name).option("path", path).option("checkpointLocation", where).trigger(**trigger).start()


def log_topics(raw: DataFrame, path: str, checkpoint: str | None = None, every: str | None = EVERY):
    """Logs, stamped with their arrival, into topics that hand each record on once.

    The sink keeps a log of the files of each batch. Files of a try that failed are
    not in it, and readers (``topics.committed_stream``) go by the log, so they see
    no record twice, nor half a batch. ``log_routing`` also archives, or takes other sinks.
    """
    carried = ("received_at", *[c for c in ("offset",) if c in raw.columns])
    stamped = logs.stamp_receive_time(raw.select("value", *carried), F.col("received_at"))
    _keep_rejected(stamped, path, "log_topics", checkpoint, every)
    return _committed(logs.route_logs(stamped, carried), path, "log_topics", checkpoint, every)


def cdc_topics(raw: DataFrame, path: str, checkpoint: str | None = None, every: str | None = EVERY):
    """Database changes into topics that hand each record on once; needs the ``offset`` of the entries
    to tell the order of changes within a moment."""
    carried = ("received_at", "offset")
    placed = raw if "offset" in raw.columns else raw.withColumn("offset", F.lit(None).cast("bigint"))
    decoded = decode.cdc_entries(placed, carried)
    _keep_rejected(decoded, path, "cdc_topics", checkpoint, every)
    entries = cdc.route_cdc(decode.accepted(decoded)).withColumnRenamed("ts", "changed_at")
    return _committed(cdc.flatten_cdc(entries, ("received_at", "changed_at", "offset")), path, "cdc_topics", checkpoint, every)
