"""The coupon rule against hand-checked rows and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from retailstream.operators import coupons

from .conftest import rows

# The rule's worked example: device 1 trips it, 2 has a click, 3 one account.
EXAMPLE = [
    (1, "coupon", "u1"), (1, "coupon", "u2"), (1, "coupon", "u3"), (1, "coupon", "u4"), (1, "coupon", "u3"),
    (2, "coupon", "u4"), (2, "coupon", "u5"), (2, "coupon", "u6"), (3, "coupon", "u6"), (3, "coupon", "u6"),
    (2, "click", "u7"),
]
SCHEMA = "mid string, uid string, evid string, itemid string, ts bigint"


def test_worked_example(spark):
    frame = spark.createDataFrame(EXAMPLE, "device int, event string, account string")
    assert rows(coupons.static_rule(frame, "device", "event", "account")) == [(1, 4)]


def test_thresholds(spark):
    frame = spark.createDataFrame(EXAMPLE, "device int, event string, account string")
    assert rows(coupons.static_rule(frame, "device", "event", "account", min_accounts=5)) == []
    assert rows(coupons.static_rule(frame, "device", "event", "account", click="none", min_accounts=3)) == [(1, 4), (2, 3)]


def random_events(seed, span_s):
    """Some 80 devices, with events often on window edges."""
    rng = random.Random(seed)
    events = []
    for device in range(80):
        click = rng.choice([0.0, 0.0, 0.1, 0.3])
        for _ in range(rng.randint(1, 14)):
            ms = rng.randint(0, span_s) * 1000 + rng.choice([0, 0, 1, 999])
            draw = rng.random()
            evid = "clickItem" if draw < click else rng.choice(["coupon", "coupon", "coupon", "addCart"])
            uid = rng.choice(["u1", "u2", "u3", "u4", None])
            events.append((f"m{device}", uid, evid, rng.choice(["i1", "i2"]), ms))
    return events


def brute_force(events, window_ms, slide_ms, least):
    alerts = {}
    for device in {e[0] for e in events}:
        own = [e for e in events if e[0] == device]
        first = (min(e[4] for e in own) - window_ms) // slide_ms * slide_ms
        for start in range(first, max(e[4] for e in own) + 1, slide_ms):
            inside = [e for e in own if start <= e[4] < start + window_ms]
            accounts = {e[1] for e in inside if e[2] == "coupon" and e[1] is not None}
            if len(accounts) >= least and not any(e[2] == "clickItem" for e in inside):
                alerts[device, start] = inside
    return alerts


@pytest.mark.parametrize("seed,window,slide,least", [
    (1, 60, 60, 2), (2, 60, 5, 2), (3, 60, 20, 3), (4, 300, 5, 3), (5, 30, 10, 1),
])
def test_windows_equal_brute_force(spark, seed, window, slide, least):
    events = random_events(seed, 4 * window)
    frame = spark.createDataFrame(events, SCHEMA)
    want = brute_force(events, window * 1000, slide * 1000, least)
    alerts = coupons.alert_windows(frame, window, slide, least)
    assert rows(alerts, "mid", "window_start", "accounts") == sorted(
        ((m, s, len({e[1] for e in inside if e[2] == "coupon"} - {None})) for (m, s), inside in want.items()), key=repr)

    documents = rows(coupons.listed_events(coupons.alert_documents(frame, alerts, window)),
                     "mid", "uids", "itemIds", "events", "ts")
    expected = sorted((
        (m, sorted({e[1] for e in inside if e[2] == "coupon"} - {None}),
         sorted({e[3] for e in inside if e[2] == "coupon"}), sorted(e[2] for e in inside), s + window * 1000)
        for (m, s), inside in want.items()), key=repr)
    assert documents == expected

    # Panes, as the stream counts them, stand in for events.
    timed = frame.withColumn("event_time", F.timestamp_millis("ts"))
    panes = coupons.counted_panes(timed, slide)
    counted = coupons.listed_events(coupons.alert_documents(panes, alerts, window, slide))
    assert rows(counted, "mid", "uids", "itemIds", "events", "ts") == expected


def test_a_busy_device_is_counted_before_it_is_joined(spark):
    """20,000 events of a device in sixty windows each: rows joined follow windows and findings."""
    frame = spark.range(20_000).select(
        F.lit("m").alias("mid"), (F.col("id") % 4).cast("string").alias("uid"), F.lit("coupon").alias("evid"),
        F.lit("i").alias("itemid"), (F.col("id") * 30).alias("ts"))
    alerts = coupons.alert_windows(frame)
    members = coupons.alert_members(frame, alerts)
    windows, found = alerts.count(), members.count()
    assert windows > 100 and found == 6 * windows
    joins = []

    def walk(plan):
        if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows"):
            joins.append(plan.metrics().apply("numOutputRows").value())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))
        if plan.nodeName() == "AdaptiveSparkPlan":
            walk(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            walk(plan.plan())

    members.collect()
    walk(members._jdf.queryExecution().executedPlan())
    assert joins and max(joins) <= 2 * found


def test_window_edges(spark):
    """A window holds its start and not its end."""
    events = [("m", "u1", "coupon", "i", 0), ("m", "u2", "coupon", "i", 300_000), ("n", "u1", "coupon", "i", 0),
              ("n", "u2", "coupon", "i", 299_999)]
    alerts = coupons.alert_windows(spark.createDataFrame(events, SCHEMA), min_accounts=2)
    assert rows(alerts, "mid", "window_start") == [("n", 0)]


def test_last_alert_of_each_minute(spark):
    alerts = spark.createDataFrame(
        [("m", 5_000, 65_000, 3), ("m", 10_000, 70_000, 4), ("m", 65_000, 125_000, 3), ("n", 0, 60_000, 5)],
        "mid string, window_start bigint, window_end bigint, accounts int")
    assert rows(coupons.latest_per_minute(alerts)) == [
        ("m", 10_000, 70_000, 4), ("m", 65_000, 125_000, 3), ("n", 0, 60_000, 5)]


def test_length_must_fit_slide(spark):
    with pytest.raises(ValueError):
        coupons.alert_windows(spark.createDataFrame([], SCHEMA), 7, 2)


def test_documents_are_named_by_device_and_minute(spark):
    events = [("m", f"u{i}", "coupon", "i", 60_000 * 28_000_000 + i) for i in range(3)]
    frame = spark.createDataFrame(events, SCHEMA)
    last = coupons.latest_per_minute(coupons.alert_windows(frame))
    documents = coupons.alert_documents(frame, last)
    assert documents.columns == ["alert_id", "mid", "uids", "itemIds", "events", "ts", "dt"]
    ids = [r.alert_id for r in documents.orderBy("ts").collect()]
    assert ids == [f"m-{28_000_000 + i}" for i in range(6)]
    assert {r.dt for r in documents.collect()} == {"2023-03-28"}
