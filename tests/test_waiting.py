"""Orders and details that wait in tables, and topics that hand records on once."""

import json
import random
from datetime import timedelta
from pathlib import Path

import pytest

from retailstream import schemas
from retailstream.sources import decode, topics
from retailstream.streaming import jobs, sinks, waiting

from .conftest import rows
from .test_changes import forget_commit
from .test_streaming import START, Feed, finish, order, startup


def detail(id, order_id, name="red gear"):
    return {"id": id, "order_id": order_id, "sku_name": name, "sku_id": "5", "order_price": "64.75", "img_url": "", "sku_num": "2"}


def run(spark, tmp_path, orders, details, **how):
    query = jobs.sale_details_from_rooms(
        orders.stream(), details.stream(), str(tmp_path / "users"), str(tmp_path / "sales"), str(tmp_path / "mark"), every=None, **how)
    finish(query)
    return query


def told(spark, tmp_path):
    """(sold details, orders and details that were told as alone)."""
    sold = rows(jobs.read_sales(spark, str(tmp_path / "sales")), "order_detail_id", "order_id")
    alone = spark.read.parquet(str(tmp_path / "sales_alone"))
    return sold, rows(alone, "side", "id", "reason")


def test_both_bounds_of_the_wait(spark, tmp_path):
    orders, details = Feed(spark, tmp_path / "o"), Feed(spark, tmp_path / "d")
    orders.add((order("1"), 0), (order("2"), 0))
    details.add((detail("d1", "1"), 0), (detail("d3", "3"), 0))     # same batch; detail first
    orders.add((order("3"), 100), (order("4"), 100))                 # exactly on the bound
    details.add((detail("d2", "2"), 90), (detail("d4", "1"), 101))   # order first; too late
    orders.add((order("9"), 5000), "{broken")
    details.add((detail("d9", "x"), 5000))
    orders.add((order("8"), 7000), (order("5"), 100))
    details.add((detail("d8", "8"), 7000))
    run(spark, tmp_path, orders, details)
    sold, alone = told(spark, tmp_path)
    assert sold == [("d1", "1"), ("d2", "2"), ("d3", "3"), ("d8", "8")]
    assert alone == [
        ("detail", "d4", "expired"), ("detail", "d9", "expired"), ("order", "4", "expired"), ("order", "5", "late"), ("order", "9", "expired"),
    ]
    assert len(rows(spark.read.text(str(tmp_path / "sales_rejected")))) == 1


@pytest.mark.parametrize("seed", [3, 4])
def test_sold_and_told_add_up_to_the_input(spark, tmp_path, seed):
    """Random arrivals in many batches, with a restart and a batch that is run again."""
    draw = random.Random(seed)
    orders, details = Feed(spark, tmp_path / "o"), Feed(spark, tmp_path / "d")
    sent_o, sent_d = [], []
    for n in range(6):
        now = n * 150
        o = [(f"{n}{i}", now + draw.randrange(150)) for i in range(4)]
        d = [(f"d{n}{i}", f"{max(0, n - draw.randrange(3))}{draw.randrange(5)}", now + draw.randrange(150)) for i in range(9)]
        orders.add(*[(order(i), t) for i, t in o])
        details.add(*[(detail(i, of), t) for i, of, t in d])
        sent_o, sent_d = sent_o + o, sent_d + d
        if n == 3:
            run(spark, tmp_path, orders, details, late_seconds=200)
            forget_commit(tmp_path / "mark", 3)
    # What ends the wait of all before.
    orders.add((order("end"), 50_000))
    details.add((detail("end", "end"), 50_000))
    orders.add((order("last"), 50_001))
    details.add((detail("last", "last"), 50_001))
    query = run(spark, tmp_path, orders, details, late_seconds=200)
    assert all(not p["stateOperators"] for p in query.recentProgress)
    pairs = {(d, o) for d, of, t in sent_d for o, s in sent_o if o == of and abs(t - s) <= 100}
    sold, alone = told(spark, tmp_path)
    assert set(sold) == pairs | {("end", "end"), ("last", "last")}
    expected = [("order", o, "expired") for o, _ in sent_o if o not in {p[1] for p in pairs}]
    expected += [("detail", d, "expired") for d, _, _ in sent_d if d not in {p[0] for p in pairs}]
    assert alone == sorted(expected)


def frames(spark, orders, details):
    """Decoded orders and details of (record, seconds after START)."""
    raw = lambda made: spark.createDataFrame([(json.dumps(r), START + timedelta(seconds=s)) for r, s in made], "value string, received_at timestamp")
    return (decode.accepted(decode.order_infos(raw(orders), ("received_at",))), decode.accepted(decode.order_details(raw(details), ("received_at",))))


def test_spark_splits_a_hot_order(spark, tmp_path):
    room = waiting.Room(str(tmp_path / "room"))
    waiting.create(spark, room)
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    }
    before = {name: spark.conf.get(name) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        lines = [(detail(f"h{i}", "hot"), i % 60) for i in range(4000)] + [(detail(f"c{i}", str(i)), 5) for i in range(50)]
        o, d = frames(spark, [(order("hot"), 0), *[(order(str(i)), 1) for i in range(50)]], lines)
        pairs, alone = waiting.admit(o, d.repartition(8), sinks.Turn("1", 0), room)
        pairs = pairs.select("d.id")
        assert len(pairs.collect()) == 4050
        assert "skewed" in pairs._jdf.queryExecution().executedPlan().toString()
        assert alone.count() == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_a_batch_opens_the_slots_that_it_can_reach(spark, tmp_path):
    room = waiting.Room(str(tmp_path / "room"))
    waiting.create(spark, room)
    for number, second in enumerate((0, 3600, 3660)):
        waiting.admit(*frames(spark, [(order(str(number)), second)], [(detail("d", "x"), second)]), sinks.Turn("1", number), room)
    first = int(START.timestamp()) // 60
    found = waiting._slots(spark, room.place("orders"), waiting._ORDERS, first + 59, first + 61)
    assert rows(found, "id") == [("1",), ("2",)]
    assert all("/slot=" in name and f"/slot={first}/" not in name for name in found.inputFiles())
    wide = waiting._slots(spark, room.place("orders"), waiting._ORDERS, first, first + 10 * waiting.NAMED_SLOTS)
    assert rows(wide, "id") == [("0",), ("1",), ("2",)]


def test_topics_hand_each_record_on_once(spark, tmp_path):
    """The writer dies between writing its files and saying so, and starts again."""
    source, path, mark = Feed(spark, tmp_path / "in"), str(tmp_path / "topics"), str(tmp_path / "mark")
    for i in range(3):
        source.add((startup(f"m{i}", "1", 0), i), ("{bad", i), ({"type": "event", "mid": f"e{i}"}, i))
    finish(jobs.log_topics(source.stream(), path, mark, every=None))
    stream = topics.committed_stream(spark, path, schemas.STARTUP_TOPIC)
    keep = lambda batch, turn: sinks.write_batch(batch.select("value"), turn, str(tmp_path / "read"))
    finish(jobs.start(stream, keep, "reader", str(tmp_path / "mark_reader"), every=None))
    # The last batch is neither in the log of the sink nor in that of the query; its files are there.
    for log in (Path(mark) / "commits", Path(path) / "_spark_metadata"):
        for name in ("2", ".2.crc"):
            (log / name).unlink(missing_ok=True)
    files = len(list(Path(path).rglob("*.parquet")))
    source.add((startup("m3", "1", 0), 9))
    finish(jobs.log_topics(source.stream(), path, mark, every=None))
    assert len(list(Path(path).rglob("*.parquet"))) > files + 1  # what the first try has left is still there
    mids = lambda frame: sorted(json.loads(r.value)["mid"] for r in frame.select("value").collect())
    assert mids(topics.committed(spark, path, schemas.STARTUP_TOPIC)) == ["m0", "m1", "m2", "m3"]
    assert mids(topics.committed(spark, path, schemas.EVENT_TOPIC)) == ["e0", "e1", "e2"]
    assert len(rows(spark.read.text(path + "_rejected"))) == 3


def test_changes_go_to_committed_topics(spark, tmp_path):
    source, path = Feed(spark, tmp_path / "in"), str(tmp_path / "topics")
    image = [{"name": "id", "value": "1"}, {"name": "create_time", "value": "2024-01-15 10:00:01"}]
    entry = {"entry_type": "ROWDATA", "table_name": "order_info", "event_type": "INSERT", "ts": 1, "rows": [image, image]}
    source.add((entry, 1), (entry | {"event_type": "DELETE"}, 1), ("[", 1))
    finish(jobs.cdc_topics(source.stream(), path, str(tmp_path / "mark"), every=None))
    got = topics.committed(spark, path, schemas.ORDER_TOPIC)
    assert sorted((json.loads(r.value)["id"], r.position) for r in got.collect()) == [("1", 0), ("1", 1)]
    # The next job takes them.
    finish(jobs.order_facts(topics.committed_stream(spark, path, schemas.ORDER_TOPIC), str(tmp_path / "orders"), str(tmp_path / "mark2"), every=None))
    assert rows(jobs.read_orders(spark, str(tmp_path / "orders")), "id") == [("1",)]
