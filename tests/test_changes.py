"""Orders that move, sums that follow them, and tables looked up by key."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from retailstream import schemas
from retailstream.operators import changes, dedup
from retailstream.plans import realtime, revenue
from retailstream.streaming import jobs, keyed, sinks

from .conftest import rows
from .test_streaming import Feed, finish, order, startup

USER = keyed.Keyed("", schemas.USER_WIRE, ("id",), buckets=4, every=3)


def forget_commit(mark, number):
    """Make the query run a batch again: it has been written, and the driver died before it said so."""
    for name in (str(number), f".{number}.crc"):
        (Path(mark) / "commits" / name).unlink(missing_ok=True)


def moving_orders(seed, batches):
    """Batches of orders; most come again with another day, hour or amount, some move back."""
    draw = random.Random(seed)
    for _ in range(batches):
        yield [
            order(str(draw.randrange(25)), at=f"2024-01-{draw.randrange(14, 18)} {draw.randrange(24):02d}:00:00",
                  amount=f"{draw.randrange(100_000) / 100:.2f}", status=draw.choice("PQR"))
            for _ in range(draw.randrange(1, 12))
        ]


@pytest.mark.parametrize("seed", [1, 2])
def test_hours_follow_orders_that_move(spark, tmp_path, seed):
    source, table, mark = Feed(spark, tmp_path / "in"), str(tmp_path / "orders"), str(tmp_path / "mark")
    last = {}
    for n, batch in enumerate(moving_orders(seed, 6)):
        # Times of arrival tell versions of a batch apart.
        source.add(*[(o, n * 100 + i) for i, o in enumerate(batch)])
        last.update({o["id"]: o for o in batch})
        if n in (2, 5):
            finish(jobs.order_facts(source.stream(), table, mark, every=None))
            forget_commit(mark, n)
            finish(jobs.order_facts(source.stream(), table, mark, every=None))
    expected = sorted((o["id"], o["create_time"][:10], o["create_time"][11:13], float(o["total_amount"])) for o in last.values())
    assert rows(jobs.read_orders(spark, table), "id", "create_date", "create_hour", "total_amount") == sorted(expected, key=repr)
    for day in ("2024-01-14", "2024-01-15", "2024-01-16", "2024-01-17"):
        own = [o for o in expected if o[1] == day]
        assert rows(jobs.read_orders(spark, table, [day]), "id", "create_date", "create_hour", "total_amount") == sorted(own, key=repr)
        hours = jobs.read_order_hours(spark, table, [day])
        assert revenue.gmv_total(hours, day).first().amount == pytest.approx(sum(o[3] for o in own) if own else None)
        by_hour = {r.hour: r.amount for r in revenue.gmv_by_hour(hours, day).collect()}
        assert by_hour == pytest.approx({h: sum(o[3] for o in own if o[2] == h) for h in {o[2] for o in own}})
        both = jobs.read_order_hours(spark, table, [realtime._day_before(day), day])
        assert rows(realtime.hours_amount(both, day)) == [
            (r.hour, pytest.approx(r.yesterday), pytest.approx(r.today))
            for r in sorted(realtime.hours_amount(jobs.read_orders(spark, table), day).collect(), key=repr)
        ]


def folders_read(frame):
    return {name.rsplit("/", 1)[0] for name in frame.inputFiles()}


def test_reports_of_a_day_open_that_day(spark, tmp_path):
    source, table = Feed(spark, tmp_path / "in"), str(tmp_path / "orders")
    source.add(order("1"), order("2"), order("3", at="2024-01-17 01:00:00"))
    source.add((order("1", at="2024-01-16 09:00:00"), 5))
    finish(jobs.order_facts(source.stream(), table, str(tmp_path / "mark"), every=None))
    for read in (jobs.read_orders, jobs.read_order_hours):
        found = folders_read(read(spark, table, ["2024-01-15"]))
        assert found and all("/create_date=2024-01-15/" in name for name in found)
    # One row per hour and batch that changed it, whatever the number of orders.
    kept = sinks.read_versions(spark, table + "_hours", schemas.ORDER_HOUR, ("create_date", ["2024-01-15"]))
    assert rows(kept, "create_hour", "orders") == [("10", -1), ("10", 2)]


def test_an_order_that_comes_back_to_its_day(spark, tmp_path):
    source, table = Feed(spark, tmp_path / "in"), str(tmp_path / "orders")
    for n, day in enumerate((15, 16, 15)):
        source.add((order("1", at=f"2024-01-{day} 10:00:00"), n))
    finish(jobs.order_facts(source.stream(), table, str(tmp_path / "mark"), every=None))
    assert rows(jobs.read_orders(spark, table, ["2024-01-15"]), "id") == [("1",)]
    assert rows(jobs.read_orders(spark, table, ["2024-01-16"]), "id") == []
    assert rows(jobs.read_order_hours(spark, table), "create_date", "orders") == [("2024-01-15", 1)]


def test_signed_versions_equal_the_last_ones(spark):
    draw = random.Random(4)
    made = [(str(draw.randrange(9)), seq, f"d{draw.randrange(3)}", f"{draw.randrange(2)}", draw.choice([1.1, 2.2, None])) for seq in range(60)]
    versions = spark.createDataFrame(made, "id string, seq int, create_date string, create_hour string, total_amount double")
    got = changes.totals(changes.hourly(changes.signed_versions(versions, "id", ["seq"])))
    last = dedup.latest_per_key(versions, ["id"], ["seq"])
    expected = last.groupBy("create_date", "create_hour").agg(
        F.count("*").alias("orders"), F.coalesce(F.sum(F.col("total_amount").cast("decimal(38,6)")), F.lit(0)).cast("double").alias("total_amount"))
    assert rows(got) == rows(expected)


def users(spark, *levels):
    return spark.createDataFrame([(str(i), None, str(v), None, None) for i, v in levels], schemas.USER_WIRE)


def test_keyed_table_equals_a_dictionary(spark, tmp_path):
    """Over several generations and runs, with each batch written twice."""
    table = USER._replace(path=str(tmp_path / "users"))
    draw, known = random.Random(6), {}
    assert rows(keyed.read(spark, table)) == []
    for run in ("1", "2"):
        for number in range(8):
            batch = {str(draw.randrange(30)): f"{run}{number}" for _ in range(5)}
            turn = sinks.Turn(run, number)
            for _ in range(2):
                had = {r.id: r.user_level for r in keyed.lookup(users(spark, *batch.items()), table, turn).collect()}
                assert had == {k: known[k] for k in batch if k in known}
                keyed.upsert(users(spark, *batch.items()), turn, table)
            known |= batch
            assert {r.id: r.user_level for r in keyed.read(spark, table).collect()} == known
        table = table._replace(buckets=7)  # taken up by the next generation
    assert len(keyed.generations(spark, table)) == 6
    assert len(keyed.outdated(spark, table)) == 4


def test_a_lookup_opens_the_buckets_of_its_keys(spark, tmp_path):
    table = USER._replace(path=str(tmp_path / "users"), buckets=16)
    keyed.upsert(users(spark, *[(i, i) for i in range(200)]), sinks.Turn("1", 0), table)
    keyed.upsert(users(spark, *[(i, -i) for i in range(50)]), sinks.Turn("1", 1), table)
    wanted = users(spark, (7, 0), (1000, 0))
    found = keyed.lookup(wanted, table)
    buckets = {r[0] for r in wanted.select(keyed.bucket_of(("id",), 16)).collect()}
    opened = {name.split("/bucket=")[1].split("/")[0] for name in folders_read(found)}
    assert opened == {str(b) for b in buckets}
    assert rows(found, "id", "user_level") == [("7", "-7")]
    assert rows(keyed.lookup(wanted.limit(0), table)) == []


def test_readers_take_no_half_written_generation(spark, tmp_path):
    table = USER._replace(path=str(tmp_path / "users"))
    for number in range(3):
        keyed.upsert(users(spark, (number, number)), sinks.Turn("1", number), table)
    # The next generation has been begun, and its name is not in the list yet.
    half = users(spark, (9, 9)).withColumns({"fold": F.lit("1-00000001-00004"), "bucket": F.lit(0)})
    sinks.write_batch(half, sinks.Turn("1", 3), table.path, ("fold", "bucket"))
    assert rows(keyed.read(spark, table), "id") == [("0",), ("1",), ("2",)]
    keyed.upsert(users(spark, (3, 3)), sinks.Turn("1", 3), table)
    assert rows(keyed.read(spark, table), "id") == [("0",), ("1",), ("2",), ("3",)]


def test_a_hot_device_is_forgotten_in_two_steps(spark, tmp_path):
    """A third of the records are of one device; no task of the second step sees them."""
    source, table = Feed(spark, tmp_path / "in"), str(tmp_path / "dau")
    records = [startup("hot", str(i), i % 80_000) for i in range(300)] + [startup(f"m{i}", "1", i) for i in range(600)]
    random.Random(2).shuffle(records)
    for i in range(0, 900, 300):
        source.add(*records[i : i + 300])
    query = jobs.daily_active_devices(source.stream(), table, str(tmp_path / "mark"), every=None, remember="state", salts=8)
    finish(query)
    got = sinks.read_versions(spark, table, schemas.STARTUP_LOG)
    expected = {(r["mid"], f"2024-01-{15 + (36_000 + (r['ts'] // 1000 - 1_705_312_800)) // 86_400}") for r in records}
    assert sorted((r.mid, r.logDate) for r in got.collect()) == sorted(expected)
    steps = [p["stateOperators"] for p in query.recentProgress if p["numInputRows"]]
    assert all(len(ops) == 2 for ops in steps)
    held = max(max(op["numRowsTotal"] for op in ops) for ops in steps)
    assert held <= len(expected) + 2 * 8
