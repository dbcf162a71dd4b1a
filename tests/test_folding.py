"""Closed days folded while readers go on, and panes found by number."""

import random

from pyspark.sql import functions as F

from retailstream import schemas
from retailstream.operators import coupons
from retailstream.sources import decode
from retailstream.streaming import folding, jobs, sinks

from .conftest import rows
from .test_changes import folders_read
from .test_streaming import Feed, event, finish

DAYS = ("2024-01-14", "2024-01-15")
KEYS = ["order_detail_id"]


def sale(id, day, name):
    return {"order_detail_id": id, "dt": day, "sku_name": name}


def write(spark, path, turn, found):
    frame = spark.createDataFrame([tuple(r.get(c) for c in schemas.SALE_DETAIL.fieldNames()) for r in found], schemas.SALE_DETAIL)
    sinks.write_batch(frame, turn, path, ("dt",))


def names(frame):
    return {(r.dt, r.order_detail_id): r.sku_name for r in frame.collect()}


def test_each_row_is_seen_once_before_while_and_after_folding(spark, tmp_path):
    path, draw, expected = str(tmp_path / "sales"), random.Random(1), {}
    sinks.create_table(spark, path, schemas.SALE_DETAIL, ("dt",))
    fold = lambda day: folding.fold_day(spark, path, schemas.SALE_DETAIL, KEYS, "dt", day)

    def check():
        for days in (None, [DAYS[0]], [DAYS[1]], list(DAYS)):
            found = jobs.read_sales(spark, path, days)
            assert found.count() == len(names(found))
            assert names(found) == {k: v for k, v in expected.items() if days is None or k[0] in days}

    fold(DAYS[0])  # nothing there yet
    for run in ("1", "2"):
        for number in range(4):
            batch = {(draw.choice(DAYS), str(draw.randrange(8))): f"{run}.{number}" for _ in range(6)}
            write(spark, path, sinks.Turn(run, number), [sale(i, d, v) for (d, i), v in batch.items()])
            expected |= batch
            if number == 1:
                begun = jobs.read_sales(spark, path, [DAYS[0]])  # a reader that goes on while the day is folded
                seen = {k: v for k, v in expected.items() if k[0] == DAYS[0]}
                fold(DAYS[0])
                assert names(begun) == seen
            check()
    fold(DAYS[0])
    check()
    folding.remove_folded(spark, path, "dt", DAYS[0])
    check()
    # What is left of the day is one folder of rows, whatever the batches were.
    found = jobs.read_sales(spark, path, [DAYS[0]])
    assert len(folders_read(found)) == 1
    # A late record of the folded day still counts, and so does the next folding.
    write(spark, path, sinks.Turn("2", 9), [sale("1", DAYS[0], "late")])
    expected[(DAYS[0], "1")] = "late"
    check()
    fold(DAYS[0])
    folding.remove_folded(spark, path, "dt", DAYS[0])
    check()


def test_orders_that_left_a_folded_day(spark, tmp_path):
    from .test_streaming import order

    source, table, mark = Feed(spark, tmp_path / "in"), str(tmp_path / "orders"), str(tmp_path / "mark")
    source.add((order("1"), 0), (order("2"), 0), (order("3"), 0))
    source.add((order("1", at="2024-01-16 09:00:00"), 5))
    finish(jobs.order_facts(source.stream(), table, mark, every=None))
    folding.fold_day(spark, table, schemas.ORDER_VERSION, ["id"], "create_date", "2024-01-15")
    assert rows(jobs.read_orders(spark, table, ["2024-01-15"]), "id") == [("2",), ("3",)]
    source.add((order("2", at="2024-01-16 09:00:00"), 9), (order("1", at="2024-01-15 11:00:00"), 9))
    finish(jobs.order_facts(source.stream(), table, mark, every=None))
    assert rows(jobs.read_orders(spark, table, ["2024-01-15"]), "id") == [("1",), ("3",)]
    assert rows(jobs.read_orders(spark, table), "id", "create_date") == [("1", "2024-01-15"), ("2", "2024-01-16"), ("3", "2024-01-15")]


def test_alerts_after_an_idle_year_and_a_restart(spark, tmp_path, monkeypatch):
    source, table, panes, mark = Feed(spark, tmp_path / "in"), str(tmp_path / "alerts"), str(tmp_path / "panes"), str(tmp_path / "mark")
    year = 366 * 86_400
    bursts = [event("m1", f"u{i}", "coupon", second + i, i) for second in (0, 200, 7000, year, year + 250) for i in range(3)]
    opened = []
    whole = sinks.read_versions
    monkeypatch.setattr(sinks, "read_versions", lambda s, p, schema, only=None: (opened.append((p, only)), whole(s, p, schema, only))[1])
    for part in (bursts[:4], bursts[4:9], bursts[9:12], bursts[12:], [event("m9", "u", "coupon", year + 10_000)], [event("m9", "u", "coupon", year + 20_000)]):
        source.add(*part)
        if len(part) != 5:
            finish(jobs.coupon_alerts(source.stream(), table, panes, mark, every=None))
    assert opened and all(only is not None and len(only[1]) <= 3 for p, only in opened if p == panes)
    events = decode.accepted(decode.event_logs(source.batch())).filter(F.col("mid") == "m1")
    expected = coupons.alert_documents(events, coupons.latest_per_minute(coupons.alert_windows(events)))
    keep = ("alert_id", "uids", "itemIds", "ts", "dt")
    got = jobs.read_alerts(spark, table)
    assert rows(got, *keep) == rows(expected, *keep) and got.count() > 3
