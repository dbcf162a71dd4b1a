"""The continuous jobs: what they write equals the batch result on the same
records, however the records are split into batches, and also after a restart."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from retailstream import schemas
from retailstream.operators import coupons, dedup
from retailstream.plans import activity, realtime, sales
from retailstream.sources import decode, fixtures, logs, topics
from retailstream.streaming import jobs, sinks

from .conftest import rows

RAW = "value STRING, received_at TIMESTAMP"
START = datetime(2024, 1, 15, 10, 0, 0, tzinfo=timezone.utc)


class Feed:
    """A folder that gets one file per call; each file becomes one micro-batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.count = spark, folder, 0

    def add(self, *records, at=None):
        """``records``: JSON values, or (value, seconds after START) pairs."""
        lines = []
        for record in records:
            value, second = record if isinstance(record, tuple) else (record, at or 0)
            text = value if isinstance(value, str) else json.dumps(value)
            when = START + timedelta(seconds=second)
            lines.append(json.dumps({"value": text, "received_at": when.strftime("%Y-%m-%dT%H:%M:%S.%fZ")}))
        self.folder.mkdir(parents=True, exist_ok=True)
        path = self.folder / f"part-{self.count:05d}.json"
        path.write_text("\n".join(lines) + "\n")
        # Files are taken in order of their times; keep these apart.
        os.utime(path, (1_700_000_000 + self.count, 1_700_000_000 + self.count))
        self.count += 1

    def stream(self):
        self.folder.mkdir(parents=True, exist_ok=True)
        return (
            self.spark.readStream.schema(RAW).option("maxFilesPerTrigger", "1").json(str(self.folder))
        )

    def batch(self):
        return self.spark.read.schema(RAW).json(str(self.folder))


@pytest.fixture
def feed(spark, tmp_path):
    return lambda name: Feed(spark, tmp_path / name)


def finish(query):
    query.awaitTermination(180)
    assert query.exception() is None
    assert not query.isActive


def startup(mid, uid, second):
    ts = int((START + timedelta(seconds=second)).timestamp() * 1000)
    return {"type": "startup", "mid": mid, "uid": uid, "os": "ios", "appid": "app", "area": "beijing",
            "ch": "appstore", "vs": "1.2.0", "ts": ts}


def event(mid, uid, evid, second, item=1):
    ts = int((START + timedelta(seconds=second)).timestamp() * 1000)
    return {"type": "event", "mid": mid, "uid": uid, "evid": evid, "pgid": 1, "npgid": 2, "itemid": item, "ts": ts}


def test_daily_active_devices(spark, feed, tmp_path):
    source, table, mark = feed("in"), str(tmp_path / "dau"), str(tmp_path / "mark")
    source.add(startup("a", "1", 5), startup("a", "2", 3), startup("b", "3", 9), "{bad")
    source.add(startup("a", "4", 1), startup("c", "5", 20))
    finish(jobs.daily_active_devices(source.stream(), table, mark, every=None))
    # A restart goes on where the run before stopped.
    day = 86400
    source.add(startup("b", "9", 30), startup("b", "6", day), startup("a", "7", day + 1), startup("a", "8", day + 2))
    finish(jobs.daily_active_devices(source.stream(), table, mark, every=None))

    got = sinks.read_versions(spark, table, schemas.STARTUP_LOG)
    assert rows(got, "logDate", "mid", "uid", "logHour") == [
        ("2024-01-15", "a", "2", "10"),
        ("2024-01-15", "b", "3", "10"),
        ("2024-01-15", "c", "5", "10"),
        ("2024-01-16", "a", "7", "10"),
        ("2024-01-16", "b", "6", "10"),
    ]


def test_daily_active_devices_from_state(spark, feed, tmp_path):
    source, table, mark = feed("in"), str(tmp_path / "dau"), str(tmp_path / "mark")
    day = 86400
    source.add(startup("a", "1", 5), startup("a", "2", 3), startup("b", "3", 9), "{bad")
    source.add(startup("a", "4", 1), startup("c", "5", 20), startup("a", "6", day))
    finish(jobs.daily_active_devices(source.stream(), table, mark, every=None, remember="state"))
    source.add(startup("b", "9", 30), startup("b", "6", day), startup("a", "7", day + 1))
    finish(jobs.daily_active_devices(source.stream(), table, mark, every=None, remember="state"))
    got = sinks.read_versions(spark, table, schemas.STARTUP_LOG)
    assert rows(got, "logDate", "mid") == [
        ("2024-01-15", "a"), ("2024-01-15", "b"), ("2024-01-15", "c"), ("2024-01-16", "a"), ("2024-01-16", "b")]
    with pytest.raises(ValueError):
        jobs.daily_active_devices(source.stream(), table, mark, remember="heart")


def test_daily_active_devices_equals_batch(spark, folder, tmp_path):
    """On the sample, cut by time so that first batch and overall first agree."""
    table = str(tmp_path / "dau")
    raw = fixtures.log_json(spark, folder).filter(F.get_json_object("value", "$.type") == "startup")
    ordered = raw.withColumnRenamed("sent_at", "received_at").orderBy("received_at").collect()
    source = tmp_path / "in"
    source.mkdir()
    step = len(ordered) // 4 + 1
    for i in range(0, len(ordered), step):
        lines = [r.value for r in ordered[i : i + step]]
        path = source / f"part-{i:05d}.txt"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = topics.file_stream(spark, str(source), max_files=1)
    finish(jobs.daily_active_devices(stream, table, str(tmp_path / "mark"), every=None))
    got = sinks.read_versions(spark, table, schemas.STARTUP_LOG).drop(*sinks.VERSION)
    want = dedup.first_activity(fixtures.startup_log(spark, folder))
    assert rows(got.select(*want.columns)) == rows(want)
    assert sinks.read_versions(spark, table, schemas.STARTUP_LOG).select(sinks.BATCH).distinct().count() > 1


def test_batch_written_again_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "dau")
    schema = schemas.STARTUP_LOG
    sinks.create_table(spark, table, schema, ("logDate",))
    raw = spark.createDataFrame([(json.dumps(startup(m, u, s)),) for m, u, s in
                                 [("a", "1", 1), ("b", "2", 2), ("a", "3", 0)]], "value string")
    batch = decode.accepted(decode.startup_logs(raw))
    for _ in range(2):
        sinks.add_new_activity(batch, 0, table, schema)
    sinks.add_new_activity(batch, 1, table, schema)
    assert rows(sinks.read_versions(spark, table, schema), "mid", "uid", "batch_id") == [("a", "3", 0), ("b", "2", 0)]


def order(id, user="31", amount="10.5", at="2024-01-15 10:00:01", status="P"):
    return {"id": id, "province_id": "4", "consignee_tel": "13812345678", "order_status": status,
            "user_id": user, "total_amount": amount, "create_time": at}


def test_order_facts_last_version_wins(spark, feed, tmp_path):
    source, table = feed("in"), str(tmp_path / "orders")
    source.add((order("1"), 0), (order("2"), 0), (order("2", status="Q"), 1), "not json", {"id": "3", "create_time": "x"})
    source.add((order("1", status="R"), 9))
    finish(jobs.order_facts(source.stream(), table, str(tmp_path / "mark"), every=None))
    got = jobs.read_orders(spark, table)
    assert rows(got, "id", "order_status", "total_amount", "create_date", "create_hour", "consignee_tel") == [
        ("1", "R", 10.5, "2024-01-15", "10", "1381*******"),
        ("2", "Q", 10.5, "2024-01-15", "10", "1381*******"),
    ]
    assert rows(jobs.read_orders(spark, table, ["2024-01-15", "2024-01-16"])) == rows(got)
    assert rows(jobs.read_orders(spark, table, ["2024-01-15"])) == rows(got)
    assert len(rows(spark.read.text(table + "_rejected"))) == 2
    assert jobs.read_orders(spark, table, ["2024-01-16"]).count() == 0
    sinks.compact(spark, table, str(tmp_path / "compacted"), schemas.ORDER_INFO, ["id"], ("create_date",))
    compacted = sinks.read_versions(spark, str(tmp_path / "compacted"), schemas.ORDER_INFO)
    assert rows(compacted.drop(*sinks.VERSION)) == rows(got)


def test_user_dimension(spark, feed, tmp_path):
    source, table = feed("in"), str(tmp_path / "users")
    user = {"id": "31", "login_name": "u", "user_level": "1", "birthday": "1990-05-20", "gender": "F"}
    source.add((user, 0), (user | {"id": "32"}, 0), (user | {"user_level": "2"}, 5))
    source.add((user | {"user_level": "3"}, 9))
    finish(jobs.user_dimension(source.stream(), table, str(tmp_path / "mark"), every=None))
    assert rows(jobs.read_users(spark, table), "id", "user_level") == [("31", "3"), ("32", "1")]


def test_coupon_alerts_equal_batch(spark, feed, tmp_path):
    source, table, panes, mark = feed("in"), str(tmp_path / "alerts"), str(tmp_path / "panes"), str(tmp_path / "mark")
    source.add(event("m1", "u1", "coupon", 0, 1), event("m1", "u2", "coupon", 61, 2), event("m2", "u1", "coupon", 5))
    source.add(event("m1", "u3", "coupon", 125, 3), event("m1", "u3", "addCart", 126), event("m2", "u2", "coupon", 8),
               event("m2", "u3", "coupon", 9), event("m2", "u3", "clickItem", 9), event("m1", "u3", "addCart", 126))
    finish(jobs.coupon_alerts(source.stream(), table, panes, mark, every=None, late="10 seconds"))
    # A second run, whose closed panes are far apart; much later events close all panes before them.
    source.add(event("m1", "u9", "addCart", 1700))
    source.add(event("m3", "u1", "coupon", 1701), event("m3", "u2", "coupon", 1702), event("m3", "u3", "coupon", 1703))
    source.add(event("m9", "u1", "addCart", 2500))
    source.add(event("m9", "u1", "addCart", 5000))
    finish(jobs.coupon_alerts(source.stream(), table, panes, mark, every=None, late="10 seconds"))
    got = coupons.listed_events(jobs.read_alerts(spark, table))
    events = decode.accepted(decode.event_logs(source.batch()))
    last = coupons.latest_per_minute(coupons.alert_windows(events))
    want = coupons.listed_events(coupons.alert_documents(events, last))
    columns = ("alert_id", "mid", "uids", "itemIds", "events", "ts", "dt")
    assert rows(got, *columns) == rows(want, *columns)
    # Accounts 1 to 3 of m1 are together in the windows that end from second
    # 130 to 300 (minutes 2 to 5), those of m3 from 1705 to 2000 (28 to 33).
    counts = {r.mid: r["count"] for r in got.groupBy("mid").count().collect()}
    assert counts == {"m1": 4, "m3": 6}


def test_coupon_alerts_on_the_sample(spark, folder, tmp_path):
    table, panes = str(tmp_path / "alerts"), str(tmp_path / "panes")
    raw = fixtures.log_json(spark, folder).filter(F.get_json_object("value", "$.type") == "event")
    ordered = [r.value for r in raw.orderBy("sent_at").collect()]
    source = tmp_path / "in"
    source.mkdir()
    for i in range(0, len(ordered), 250):
        path = source / f"part-{i:05d}.txt"
        path.write_text("\n".join(ordered[i : i + 250]) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = topics.file_stream(spark, str(source), max_files=1)
    finish(jobs.coupon_alerts(stream, table, panes, str(tmp_path / "mark"), every=None, late="1 hour",
                              window_seconds=6 * 3600, slide_seconds=3600))
    upto = sinks.read_versions(spark, panes, schemas.COUPON_PANE).agg(F.max("ts")).first()[0] + 3600_000
    events = fixtures.event_log(spark, folder)
    alerts = coupons.alert_windows(events, 6 * 3600, 3600).filter(F.col("window_end") <= upto)
    want = coupons.alert_documents(events, alerts, 6 * 3600)
    columns = ("alert_id", "uids", "itemIds", "events", "ts")
    assert rows(coupons.listed_events(jobs.read_alerts(spark, table)), *columns) == rows(
        coupons.listed_events(want), *columns)
    assert want.count() > 10


def test_sale_details_wait_for_each_other(spark, feed, tmp_path):
    orders, details = feed("orders"), feed("details")
    users, table = str(tmp_path / "users"), str(tmp_path / "sales")
    user_feed = feed("users_in")
    user_feed.add({"id": "31", "login_name": "u", "user_level": "1", "birthday": "1990-05-20", "gender": "F"})
    finish(jobs.user_dimension(user_feed.stream(), users, str(tmp_path / "mark_u"), every=None))

    def detail(id, order_id):
        return {"id": id, "order_id": order_id, "sku_name": "red gear", "sku_id": "5", "order_price": "64.75",
                "img_url": "", "sku_num": "2"}

    orders.add((order("1"), 0), (order("2", user="77"), 0))
    details.add((detail("d1", "1"), 0), (detail("d3", "3"), 0))     # same batch; detail first
    orders.add((order("3"), 100), (order("4"), 100))                 # exactly on the bound
    details.add((detail("d2", "2"), 90), (detail("d4", "1"), 101))   # order first; too late
    orders.add((order("9"), 2000))
    details.add((detail("d9", "x"), 2000))
    details.add("{broken")
    finish(jobs.sale_details(orders.stream(), details.stream(), users, table, str(tmp_path / "mark"), every=None))
    got = jobs.read_sales(spark, table)
    assert rows(got, "order_detail_id", "order_id", "user_gender", "user_level", "sku_price", "dt") == [
        ("d1", "1", "F", "1", 64.75, "2024-01-15"),
        ("d2", "2", None, None, 64.75, "2024-01-15"),
        ("d3", "3", "F", "1", 64.75, "2024-01-15"),
    ]
    assert got.columns == schemas.SALE_DETAIL.fieldNames()

    # Rows that found no partner come out when their wait is over, if asked for.
    from retailstream.operators.joins import within_wait

    def timed(frames):
        o = decode.accepted(decode.order_infos(frames(orders), ("received_at",)))
        d = decode.accepted(decode.order_details(frames(details), ("received_at",)))
        return (o.withColumnRenamed("received_at", "order_ts").withWatermark("order_ts", "10 seconds"),
                d.withColumnRenamed("received_at", "detail_ts").withWatermark("detail_ts", "10 seconds"))

    lonely = within_wait(*timed(Feed.stream), how="full_outer").select(F.col("o.id").alias("o"), F.col("d.id").alias("d"))
    keep = lambda batch, batch_id: sinks.write_batch(batch, batch_id, str(tmp_path / "outer"))
    finish(jobs.start(lonely, keep, "outer", str(tmp_path / "mark_outer"), every=None))
    assert rows(spark.read.parquet(str(tmp_path / "outer")), "o", "d") == [
        ("1", "d1"), ("2", "d2"), ("3", "d3"), ("4", None), (None, "d4")]

    # The batch join with the same bounds gives the same pairs, dealt out or not.
    o, d = timed(Feed.batch)
    for parts in (1, 3):
        pairs = within_wait(o, d, parts=parts)
        assert rows(pairs, F.col("d.id"), F.col("o.id")) == [("d1", "1"), ("d2", "2"), ("d3", "3")]


def test_logs_and_changes_reach_their_topics(spark, feed, tmp_path):
    source, table, archive = feed("in"), str(tmp_path / "topics"), str(tmp_path / "archive")
    log = startup("a", "1", 0)
    source.add((log, 50), ({"type": "event", "mid": "b", "pgid": 3, "ts": 1}, 51), ({"mid": "c"}, 52), ("{bad", 53))
    finish(jobs.log_routing(source.stream(), table, archive, str(tmp_path / "mark"), every=None))
    parsed = lambda topic: sorted(
        (json.loads(r.value) for r in topics.topic_table(spark, table, topic).collect()), key=str)
    ms = int(START.timestamp() * 1000)
    assert parsed(schemas.STARTUP_TOPIC) == [log | {"ts": ms + 50_000}]
    assert parsed(schemas.EVENT_TOPIC) == sorted(
        [{"type": "event", "mid": "b", "pgid": 3, "ts": ms + 51_000}, {"mid": "c", "ts": ms + 52_000}], key=str)
    assert spark.read.text(archive).count() == 3
    assert {r.dt.isoformat() for r in spark.read.text(archive).select("dt").distinct().collect()} == {"2024-01-15"}

    # Routed logs feed the next job.
    dau = str(tmp_path / "dau")
    stream = topics.topic_table_stream(spark, table, schemas.STARTUP_TOPIC)
    finish(jobs.daily_active_devices(stream, dau, str(tmp_path / "mark_dau"), every=None))
    assert rows(sinks.read_versions(spark, dau, schemas.STARTUP_LOG), "mid", "ts") == [("a", ms + 50_000)]

    # The Kafka writer takes the same routed records (nothing is started here).
    stamped = logs.stamp_receive_time(source.stream(), F.col("received_at"))
    assert sinks.kafka_sink(logs.route_logs(stamped), "broker:9092") is not None

    changes = feed("cdc")
    image = [{"name": "id", "value": "1"}, {"name": "create_time", "value": "2024-01-15 10:00:01"}]
    entry = {"entry_type": "ROWDATA", "table_name": "order_info", "event_type": "INSERT", "ts": 1, "rows": [image, image]}
    changes.add((entry, 1), (entry | {"event_type": "DELETE"}, 1), (entry | {"table_name": "other"}, 1),
                (entry | {"entry_type": "TRANSACTIONEND"}, 1), ("[", 1))
    finish(jobs.cdc_routing(changes.stream(), table + "2", str(tmp_path / "mark_cdc"), every=None))
    got = topics.topic_table(spark, table + "2", schemas.ORDER_TOPIC)
    assert [json.loads(r.value) for r in got.collect()] == [{"id": "1", "create_time": "2024-01-15 10:00:01"}] * 2


def test_rejected_records_are_kept(spark, feed, tmp_path):
    source = feed("in")
    source.add(startup("a", "1", 0), "{bad", {"uid": "9"})
    decoded = decode.startup_logs(source.stream())
    finish(jobs.quarantine(decoded, str(tmp_path / "bad"), "bad_startup", str(tmp_path / "mark"), every=None))
    assert rows(spark.read.text(str(tmp_path / "bad")).select("value")) == [('{"uid": "9"}',), ("{bad",)]


def test_progress_goes_to_the_shared_folder(spark, feed, monkeypatch, tmp_path):
    source = feed("in")
    source.add(startup("a", "1", 0))
    monkeypatch.setattr(jobs, "shared_folder", lambda session: str(tmp_path / "shared"))
    finish(jobs.daily_active_devices(source.stream(), str(tmp_path / "dau"), every=None))
    assert (tmp_path / "shared" / "streams" / "daily_active_devices" / "offsets").exists()


def test_batch_report_on_streamed_sales(spark, folder, tmp_path):
    """Tables written by the jobs are what the reports read."""
    table = str(tmp_path / "sales")
    wide = sales.sale_detail(
        fixtures.order_info(spark, folder, "2000-01-01", "2000-03-31"), fixtures.detail_wire(spark, folder),
        fixtures.user_info(spark, folder), F.lit("2024-06-01").cast("timestamp"))
    sinks.create_table(spark, table, schemas.SALE_DETAIL, ("dt",))
    sinks.upsert_batch(wide, 0, table, ["order_detail_id"], ("dt",))
    assert rows(sales.stats(jobs.read_sales(spark, table))) == rows(sales.stats(wide))


def test_a_new_checkpoint_leaves_the_table_alone(spark, feed, tmp_path):
    table = str(tmp_path / "dau")
    for number, device in enumerate("ab"):
        source = feed(f"in{number}")
        source.add(startup(device, "1", number))
        finish(jobs.daily_active_devices(source.stream(), table, str(tmp_path / f"mark{number}"), every=None))
    assert rows(sinks.read_versions(spark, table, schemas.STARTUP_LOG), "mid") == [("a",), ("b",)]


def test_two_jobs_share_a_topic_table(spark, feed, tmp_path):
    table = str(tmp_path / "topics")
    for number, device in enumerate("ab"):
        source = feed(f"in{number}")
        source.add((startup(device, "1", 0), number))
        finish(jobs.log_routing(source.stream(), table, str(tmp_path / f"archive{number}"), str(tmp_path / f"mark{number}"), every=None))
    got = topics.topic_table(spark, table, schemas.STARTUP_TOPIC).collect()
    assert sorted(json.loads(r.value)["mid"] for r in got) == ["a", "b"]


def test_a_batch_tried_again_with_fewer_days(spark, tmp_path):
    table, schema = str(tmp_path / "dau"), schemas.STARTUP_LOG
    sinks.create_table(spark, table, schema, ("logDate",))
    raw = spark.createDataFrame([(json.dumps(startup(m, "1", s)),) for m, s in [("a", 1), ("b", 86400)]], "value string")
    batch = decode.accepted(decode.startup_logs(raw))
    turn = sinks.Turn("r", 3)
    sinks.write_batch(batch, turn, table, ("logDate",))
    sinks.write_batch(batch, sinks.Turn("q", 3), table, ("logDate",))
    sinks.write_batch(batch.filter("mid = 'a'"), turn, table, ("logDate",))
    got = sinks.read_versions(spark, table, schema)
    assert rows(got, "mid", "run_id") == [("a", "q"), ("a", "r"), ("b", "q")]


def test_poison_records_are_set_aside(spark, feed, tmp_path):
    source, table, archive = feed("in"), str(tmp_path / "topics"), str(tmp_path / "archive")
    source.add(('{"type":"startup","mid":"a","mid":"b"}', 1), ("[1]", 2), ('{"mid":"c","ts":9223372036854775807}', 3))
    finish(jobs.log_routing(source.stream(), table, archive, str(tmp_path / "mark"), every=None))
    got = [json.loads(r.value)["mid"] for r in topics.topic_table(spark, table, schemas.STARTUP_TOPIC).collect()]
    assert got == ["b"] and rows(spark.read.text(archive + "_rejected"), "value") == [("[1]",)]

    logs_in, dau = feed("logs"), str(tmp_path / "dau")
    logs_in.add(startup("a", "1", 0), startup("b", "1", 0) | {"ts": 9223372036854775807}, startup("c", "1", 0) | {"ts": -1})
    finish(jobs.daily_active_devices(logs_in.stream(), dau, str(tmp_path / "mark_dau"), every=None))
    assert rows(sinks.read_versions(spark, dau, schemas.STARTUP_LOG), "mid") == [("a",)]
    assert len(rows(spark.read.text(dau + "_rejected"))) == 2

    changes, out = feed("cdc"), str(tmp_path / "changed")
    image = [{"name": n, "value": v} for n, v in (("id", "1"), (None, "x"), ("id", "2"), ("login_name", "u"))]
    changes.add(({"entry_type": "ROWDATA", "table_name": "user_info", "event_type": "INSERT", "ts": 1, "rows": [image]}, 1))
    finish(jobs.cdc_routing(changes.stream(), out, str(tmp_path / "mark_cdc"), every=None))
    assert [json.loads(r.value) for r in topics.topic_table(spark, out, schemas.USER_TOPIC).collect()] == [{"id": "2", "login_name": "u"}]


def test_state_remembers_a_device_for_its_day(spark, feed, tmp_path):
    source, table, mark = feed("in"), str(tmp_path / "dau"), str(tmp_path / "mark")
    source.add(startup("a", "1", 0))
    source.add(startup("b", "1", 3600))
    source.add(startup("a", "2", 7200), startup("c", "1", 60))
    finish(jobs.daily_active_devices(source.stream(), table, mark, every=None, remember="state", late="10 seconds"))
    assert rows(sinks.read_versions(spark, table, schemas.STARTUP_LOG), "mid") == [("a",), ("b",), ("c",)]


def test_the_later_change_of_a_user_wins(spark, feed, tmp_path):
    """Two changes in one batch, through the topic table, whatever their text."""
    changes, topic, users = feed("cdc"), str(tmp_path / "topics"), str(tmp_path / "users")

    def change(event, level, ts):
        image = [{"name": "id", "value": "31"}, {"name": "user_level", "value": level}]
        return {"entry_type": "ROWDATA", "table_name": "user_info", "event_type": event, "ts": ts, "rows": [image]}

    two = change("INSERT", "9", 7)
    two["rows"].append([{"name": "id", "value": "32"}, {"name": "user_level", "value": "9"}])
    two["rows"].append([{"name": "id", "value": "32"}, {"name": "user_level", "value": "5"}])
    changes.add((two, 0), (change("UPDATE", "2", 8), 0), (change("UPDATE", "1", 8), 0))
    finish(jobs.cdc_routing(changes.stream(), topic, str(tmp_path / "mark"), every=None))
    stream = topics.topic_table_stream(spark, topic, schemas.USER_TOPIC)
    finish(jobs.user_dimension(stream, users, str(tmp_path / "mark_users"), every=None))
    assert rows(jobs.read_users(spark, users), "id", "user_level") == [("31", "1"), ("32", "5")]


def test_an_order_that_changes_its_day_counts_once(spark, feed, tmp_path):
    source, table = feed("in"), str(tmp_path / "orders")
    source.add((order("1"), 0), (order("2"), 0))
    source.add((order("1", at="2024-01-16 9:00:00"), 5))
    finish(jobs.order_facts(source.stream(), table, str(tmp_path / "mark"), every=None))
    assert rows(jobs.read_orders(spark, table), "id", "create_date", "create_hour") == [("1", "2024-01-16", "09"), ("2", "2024-01-15", "10")]
    assert rows(jobs.read_orders(spark, table, ["2024-01-15"]), "id") == [("2",)]


def test_routing_takes_another_sink(spark, feed, tmp_path):
    source, sent = feed("in"), []
    source.add((startup("a", "1", 0), 50), ("{bad", 53))
    keep = lambda routed, turn: sent.extend(routed.select("topic", "value").collect())
    finish(jobs.log_routing(source.stream(), None, str(tmp_path / "archive"), str(tmp_path / "mark"), every=None, sink=keep))
    assert [r.topic for r in sent] == [schemas.STARTUP_TOPIC]
    assert callable(sinks.kafka_topics("broker:9092"))


def test_jobs_with_state_keep_rejected_records_too(spark, feed, tmp_path):
    source, table = feed("in"), str(tmp_path / "alerts")
    source.add(event("m1", "u1", "coupon", 0), "{bad", {"mid": "x"})
    for turn in range(2):
        finish(jobs.coupon_alerts(source.stream(), table, str(tmp_path / "panes"), str(tmp_path / "mark"), every=None))
    assert len(rows(spark.read.text(table + "_rejected"))) == 2
    assert not [q for q in spark.streams.active if q.name.endswith("_rejected")]


def test_new_devices_by_day(spark, feed, tmp_path):
    """Records that come late move a device to the day where it belongs, and no other day changes."""
    source, table, mark, day = feed("in"), str(tmp_path / "new"), str(tmp_path / "mark"), 86400
    source.add(startup("a", "1", day + 7200), startup("b", "1", 5), startup("a", "2", 2 * day), "{bad")
    source.add(startup("c", "1", day), startup("b", "2", day))
    finish(jobs.new_devices(source.stream(), table, mark, every=None))
    assert rows(jobs.read_new_devices(spark, table)) == [
        ("a", "2024-01-16", "12"), ("b", "2024-01-15", "10"), ("c", "2024-01-16", "10")]
    source.add(startup("a", "3", day + 3600), startup("c", "2", 30), startup("d", "1", 2 * day))
    finish(jobs.new_devices(source.stream(), table, mark, every=None))
    wanted = [("a", "2024-01-16", "11"), ("b", "2024-01-15", "10"), ("c", "2024-01-15", "10"), ("d", "2024-01-17", "10")]
    assert rows(jobs.read_new_devices(spark, table)) == wanted
    logs = decode.accepted(decode.startup_logs(source.batch()))
    assert rows(activity.new_devices(logs)) == wanted
    # A job with another checkpoint reads the same records once more.
    finish(jobs.new_devices(source.stream(), table, str(tmp_path / "other"), every=None))
    assert rows(jobs.read_new_devices(spark, table)) == wanted

    days = ["2024-01-15", "2024-01-16"]
    pruned = jobs.read_new_devices(spark, table, days)
    assert rows(pruned) == wanted[:3]
    assert all(any(f"logDate={d}" in f for d in days) for f in pruned.inputFiles())
    dau = dedup.first_activity(logs)
    for metric, asked in (("new_mid", realtime.realtime_hours), ("dau", realtime.realtime_hours)):
        assert rows(asked(metric, dau, None, day=days[1], new=pruned)) == rows(asked(metric, dau, None, logs, days[1]))
