"""Named queries over the sample tables, one per operator or report."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.clock import previous_day
from .functions.values import age_band
from .operators import changes, coupons, dedup, joins, postings
from .plans import activity, realtime, revenue, sales
from .session import TIME_ZONE, prepared
from .sources import cdc, decode, fixtures, logs
from .streaming.sinks import table_columns

# Days with data in the sample tables.
LOG_DAY = "2024-01-15"
LOG_DAY_BEFORE = "2024-01-14"
ORDER_DAY = "2000-02-02"
ORDER_DAY_BEFORE = "2000-02-01"
KEYWORD = "gear"
AS_OF = "2024-06-01"
# Nearly all devices of the sample are new on the first days of its log.
NEW_DAY, NEW_DAY_BEFORE = "2024-01-02", "2024-01-01"

# The events of the sample are days apart, so its coupon windows are long.
ALERT_WINDOW, ALERT_SLIDE = 6 * 3600, 3600

Query = Callable[[SparkSession, str], DataFrame]


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _joined(column):
    return F.array_join(column, ",")


# -- decoding and routing ---------------------------------------------------


def decode_startup(spark, folder):
    routed = decode.startup_logs(_topic(fixtures.log_json(spark, folder), logs.STARTUP_TOPIC))
    return decode.accepted(routed)


def decode_event(spark, folder):
    routed = decode.event_logs(_topic(fixtures.log_json(spark, folder), logs.EVENT_TOPIC))
    return decode.accepted(routed)


def _topic(raw, name):
    return raw.filter(logs.log_topic("value") == name)


def decode_order(spark, folder):
    return decode.accepted(decode.order_infos(fixtures.as_json(fixtures.order_wire(spark, folder))))


def decode_detail(spark, folder):
    decoded = decode.order_details(fixtures.as_json(fixtures.detail_wire(spark, folder)))
    return decode.accepted(decoded)


def decode_user(spark, folder):
    return decode.accepted(decode.user_infos(fixtures.as_json(fixtures.customers_as_users(spark, folder))))


def route_logs(spark, folder):
    sent = fixtures.log_json(spark, folder, stamped=False)
    routed = logs.route_logs(logs.stamp_receive_time(sent, F.col("sent_at")))
    fields = F.from_json("value", "mid STRING, uid STRING, evid STRING, itemid STRING, ts BIGINT")
    return routed.select("topic", F.inline(F.array(fields)))


def raw_archive(spark, folder):
    sent = fixtures.log_json(spark, folder, stamped=False)
    stamped = logs.stamp_receive_time(sent, F.col("sent_at"))
    fields = F.from_json("value", "type STRING, mid STRING, uid STRING, evid STRING, itemid STRING, ts BIGINT")
    return logs.raw_archive(stamped, F.col("sent_at")).select("dt", F.inline(F.array(fields)))


def route_cdc(spark, folder):
    routed = cdc.route_cdc(fixtures.cdc(spark, folder))
    return routed.groupBy("table_name", "event_type", "topic").agg(F.count("*").alias("entries"))


def flatten_cdc(spark, folder):
    return cdc.flatten_cdc(cdc.route_cdc(fixtures.cdc(spark, folder))).select("topic", "value")


# -- devices ----------------------------------------------------------------


def dau_first_activity(spark, folder):
    return dedup.first_activity(fixtures.startup_log(spark, folder))


def dau_new_vs_seen(spark, folder):
    all_day = fixtures.startup_log(spark, folder)
    seen = dedup.first_activity(all_day.filter(F.col("logHour") < "12"))
    return dedup.new_activity(all_day.filter(F.col("logHour") >= "12"), seen)


def _dau(spark, folder, first, last):
    from .functions.clock import hour_of

    times = dedup.first_activity_time(fixtures.startup_log(spark, folder, first, last))
    return times.withColumn("logHour", hour_of("ts"))


def dau_total(spark, folder):
    return activity.dau_total(_dau(spark, folder, LOG_DAY, LOG_DAY), LOG_DAY)


def dau_by_hour(spark, folder):
    return activity.dau_by_hour(_dau(spark, folder, LOG_DAY, LOG_DAY), LOG_DAY)


def hours_dau(spark, folder):
    dau = _dau(spark, folder, LOG_DAY_BEFORE, LOG_DAY)
    return realtime.every_hour(realtime.hours_dau(dau, LOG_DAY))


def hours_new_device(spark, folder):
    seen = fixtures.startup_log(spark, folder, last=NEW_DAY)
    return realtime.every_hour(realtime.hours_new_devices(seen, NEW_DAY))


def new_devices_per_day(spark, folder):
    first = activity.new_devices(fixtures.startup_log(spark, folder))
    return first.groupBy("logDate", "logHour").agg(F.count("*").alias("devices"))


def hours_new_device_late(spark, folder):
    """New devices of two late days from the table by day that the stream job keeps: what
    each half of the log adds to it, the second half in the light of the first."""
    history = fixtures.startup_log(spark, folder)
    until = F.col("logDate") < LOG_DAY
    nothing = history.select("mid", "ts").limit(0)
    before = dedup.first_ever(history.filter(until), nothing)
    table = before.unionByName(dedup.first_ever(history.filter(~until), before.select("mid", "ts")))
    return realtime.every_hour(realtime.hours_dau(activity.first_seen(table), LOG_DAY))


def new_devices_table(spark, folder):
    """The same table with the halves of the log the wrong way round: devices that turn
    out to be older leave the day that they had."""
    history = fixtures.startup_log(spark, folder)
    late = F.col("logDate") >= LOG_DAY
    nothing = history.select("mid", "ts").limit(0)
    first = dedup.first_ever(history.filter(late), nothing)
    table = first.unionByName(dedup.first_ever(history.filter(~late), first.select("mid", "ts")))
    return activity.first_seen(table).groupBy("logDate", "logHour").agg(F.count("*").alias("devices"))


def report_json(spark, folder):
    dau = _dau(spark, folder, LOG_DAY_BEFORE, LOG_DAY)
    return realtime.hours_json(realtime.realtime_hours("dau", dau, dau, day=LOG_DAY))


# -- order amounts ----------------------------------------------------------


def _cents(frame, *columns):
    return frame.withColumns({c: F.round(c, 2) for c in columns})


def gmv_facts(spark, folder):
    return table_columns(fixtures.order_info(spark, folder, province=True))


def gmv_total(spark, folder):
    return _cents(revenue.gmv_total(fixtures.order_info(spark, folder, ORDER_DAY, ORDER_DAY), ORDER_DAY), "amount")


def gmv_by_hour(spark, folder):
    return _cents(revenue.gmv_by_hour(fixtures.order_info(spark, folder, ORDER_DAY, ORDER_DAY), ORDER_DAY), "amount")


def hours_gmv(spark, folder):
    orders = fixtures.order_info(spark, folder, ORDER_DAY_BEFORE, ORDER_DAY)
    hours = realtime.every_hour(realtime.hours_amount(orders, ORDER_DAY))
    return _cents(hours, "yesterday", "today")


def hours_gmv_unpadded(spark, folder):
    """Hours written in one digit, through decoding; they add up to the total."""
    wire = fixtures.order_wire(spark, folder, province=False, first=ORDER_DAY_BEFORE, last=ORDER_DAY)
    short = wire.withColumn("create_time", F.regexp_replace("create_time", " 0", " "))
    orders = decode.accepted(decode.order_infos(fixtures.as_json(short)))
    return _cents(realtime.every_hour(realtime.hours_amount(orders, ORDER_DAY)), "yesterday", "today")


def gmv_hours_by_change(spark, folder):
    """Order amounts per day and hour, kept up to date by what each change adds and takes back."""
    signed = changes.signed_versions(fixtures.order_moves(spark, folder), "id", ["seq"])
    return _cents(changes.totals(changes.hourly(signed)), "total_amount")


def hours_gmv_by_change(spark, folder):
    """The hour by hour comparison, from those sums in place of orders."""
    signed = changes.signed_versions(fixtures.order_moves(spark, folder), "id", ["seq"])
    hours = changes.totals(changes.hourly(signed))
    return _cents(realtime.every_hour(realtime.hours_amount(hours, ORDER_DAY)), "yesterday", "today")


def hours_previous_day(spark, folder):
    """Order amount of the day before, the date worked out from the argument."""
    orders = fixtures.order_info(spark, folder)
    before = orders.filter(F.col("create_date") == previous_day(ORDER_DAY))
    return _cents(
        before.groupBy("create_date", "create_hour").agg(F.sum("total_amount").alias("amount")), "amount"
    )


def realtime_total(spark, folder):
    return _cents(_realtime_total(spark, folder), "value")


def _realtime_total(spark, folder):
    history = fixtures.startup_log(spark, folder, last=NEW_DAY)
    dau = _dau(spark, folder, NEW_DAY, NEW_DAY)
    # The order table ends years before the logs begin: move its day to theirs.
    orders = fixtures.order_info(spark, folder, ORDER_DAY, ORDER_DAY).withColumn("create_date", F.lit(NEW_DAY))
    return realtime.realtime_total(dau, orders, history, NEW_DAY)


def gmv_by_province(spark, folder):
    return _cents(revenue.sales_by_province(fixtures.order_info(spark, folder, province=True)), "amount")


def sales_by_sku(spark, folder):
    return revenue.sales_by_sku(fixtures.detail_wire(spark, folder))


# -- orders and details -----------------------------------------------------


def order_detail_audit(spark, folder):
    """Every third order is withheld, so that details without an order occur."""
    details = fixtures.detail_wire(spark, folder, sku=False)
    orders = fixtures.order_info(spark, folder).filter(F.col("id").cast("bigint") % 3 != 0)
    sides = joins.match_sides(orders, details)
    return sides.groupBy("side").agg(F.count("*").alias("n"))


def order_detail_interval(spark, folder):
    pairs = joins.within_wait(fixtures.timed_orders(spark, folder), fixtures.timed_details(spark, folder))
    return pairs.select(
        F.col("o.id").alias("order_id"),
        F.col("d.id").alias("order_detail_id"),
        (F.unix_timestamp("d.detail_ts") - F.unix_timestamp("o.order_ts")).alias("waited"),
    )


def _sales(spark, folder, day=None, sku=True):
    return sales.sale_detail(
        fixtures.order_info(spark, folder, day, day),
        fixtures.detail_wire(spark, folder, sku),
        fixtures.user_info(spark, folder),
        _as_of(),
    )


def _hits(spark, folder, keyword=KEYWORD):
    return sales.search(_sales(spark, folder, ORDER_DAY), ORDER_DAY, keyword)


def sale_detail(spark, folder):
    return _sales(spark, folder)


def sale_keyword(spark, folder):
    return _hits(spark, folder, "Red GEAR")


def sale_keyword_postings(spark, folder):
    """The same search by the inverted index of the product names: ids of its hits on all days."""
    index = postings.postings(_sales(spark, folder), "order_detail_id", "sku_name", ("dt",))
    wanted = postings.wanted_words(index, "Red GEAR")
    return postings.having_all(index, wanted, "order_detail_id")


def sale_day(spark, folder):
    return _hits(spark, folder, "")


def sale_page(spark, folder):
    return sales.page(_hits(spark, folder), 2, 5)


def sale_page_after(spark, folder):
    return sales.page_after(_hits(spark, folder, ""), "2", 10)


def sale_total(spark, folder):
    return sales.total(_hits(spark, folder))


def sale_by_age(spark, folder):
    return sales.by_age(_sales(spark, folder, sku=False))


def sale_by_gender(spark, folder):
    return sales.by_gender(_sales(spark, folder, sku=False))


def sale_by_band(spark, folder):
    bands = _sales(spark, folder, sku=False).groupBy(age_band("user_age").alias("band"))
    return bands.agg(F.count("*").alias("hits"))


def age_share(spark, folder):
    return sales.age_share(_hits(spark, folder))


def gender_share(spark, folder):
    return sales.gender_share(_hits(spark, folder))


def sale_stats(spark, folder):
    return sales.stats(_sales(spark, folder, sku=False))


def share_counts(spark, folder):
    return sales.stats(_sales(spark, folder, sku=False), normalize=False)


def sale_report_json(spark, folder):
    """The whole answer to a search as one JSON object, a few fields read back."""
    report = sales.report_json(sales.sale_report(_sales(spark, folder, ORDER_DAY), ORDER_DAY, 1, 5, KEYWORD))
    paths = {
        "total": "$.total", "age_title": "$.stat[0].title", "under20": "$.stat[0].options[0].value",
        "female_label": "$.stat[1].options[0].name", "female": "$.stat[1].options[0].value",
        "first_id": "$.detail[0].order_detail_id", "last_id": "$.detail[4].order_detail_id",
        "last_sku": "$.detail[4].sku_name", "beyond": "$.detail[5]",
    }
    return report.select(*[F.get_json_object("report", path).alias(name) for name, path in paths.items()])


def realtime_total_json(spark, folder):
    report = realtime.total_json(_realtime_total(spark, folder))
    known = F.from_json("report", "array<struct<id:string,name:string,value:double>>")
    return report.select(F.inline(known)).select("id", "name", F.round("value", 2).alias("value"))


def share_unknown(spark, folder):
    return sales.share_counts(_sales(spark, folder, sku=False))


# -- coupons ----------------------------------------------------------------


def _alerts(spark, folder):
    return coupons.alert_windows(fixtures.event_log(spark, folder), ALERT_WINDOW, ALERT_SLIDE)


def coupon_alert(spark, folder):
    events = fixtures.event_log(spark, folder)
    documents = coupons.alert_documents(events, _alerts(spark, folder), ALERT_WINDOW, ALERT_SLIDE)
    counts = F.transform(
        F.array_sort(F.map_entries("events")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))
    )
    return documents.select(
        "alert_id", "mid", _joined("uids").alias("uids"), _joined("itemIds").alias("item_ids"),
        _joined(counts).alias("events"), "ts", "dt",
    )


def coupon_alert_members(spark, folder):
    events = fixtures.event_log(spark, folder)
    return coupons.alert_members(events, _alerts(spark, folder), ALERT_WINDOW, ALERT_SLIDE)


def coupon_alert_windows(spark, folder):
    """More than three accounts in a day, hourly: long windows, many slides."""
    return coupons.alert_windows(fixtures.event_log(spark, folder), 86400, 3600, min_accounts=4)


def coupon_alert_per_minute(spark, folder):
    """Windows a quarter minute apart, the last one of each minute kept."""
    events = fixtures.event_log(spark, folder)
    alerts = coupons.alert_windows(events, 2 * 3600, 15, min_accounts=2)
    return coupons.latest_per_minute(alerts)


def coupon_rule_static(spark, folder):
    """The rule without windows, per device and day."""
    events = fixtures.event_log(spark, folder)
    rows = events.select(F.concat_ws("/", "mid", "logDate").alias("device"), "evid", "uid")
    return coupons.static_rule(rows, "device", "evid", "uid", click="clickItem")


# -- latest per key ---------------------------------------------------------


def user_dim_latest(spark, folder):
    return dedup.latest_per_key(fixtures.user_changes(spark, folder), ["id"], ["seq"])


def order_latest(spark, folder):
    return dedup.latest_per_key(fixtures.order_changes(spark, folder), ["id"], ["seq"])


def sale_detail_latest(spark, folder):
    """Sale details of redelivered orders, the last delivery kept."""
    orders = dedup.latest_per_key(fixtures.order_changes(spark, folder), ["id"], ["seq"]).drop("seq")
    return sales.sale_detail(orders, fixtures.detail_wire(spark, folder), fixtures.user_info(spark, folder), _as_of())


_QUERIES: list[Query] = [
    decode_startup, decode_event, decode_order, decode_detail, decode_user,
    route_logs, raw_archive, route_cdc, flatten_cdc,
    dau_first_activity, dau_new_vs_seen, dau_total, dau_by_hour,
    hours_dau, hours_new_device, hours_new_device_late, new_devices_per_day, new_devices_table, report_json,
    gmv_facts, gmv_total, gmv_by_hour, hours_gmv, hours_gmv_unpadded, hours_previous_day, realtime_total,
    gmv_hours_by_change, hours_gmv_by_change,
    gmv_by_province, sales_by_sku,
    order_detail_audit, order_detail_interval,
    sale_detail, sale_keyword, sale_keyword_postings, sale_day, sale_page, sale_page_after, sale_total,
    sale_by_age, sale_by_gender, sale_by_band,
    age_share, gender_share, sale_stats, share_counts, share_unknown,
    sale_report_json, realtime_total_json,
    coupon_alert, coupon_alert_members, coupon_alert_windows, coupon_alert_per_minute,
    coupon_rule_static,
    user_dim_latest, order_latest, sale_detail_latest,
]


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        # Days of the sample are days in UTC. A frame keeps the zone that it was
        # made with, so the caller's own is put back.
        own = spark.conf.get(TIME_ZONE)
        spark.conf.set(TIME_ZONE, "UTC")
        try:
            return query(prepared(spark), folder)
        finally:
            spark.conf.set(TIME_ZONE, own)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES: dict[str, Query] = {q.__name__: _ready(q) for q in _QUERIES}
