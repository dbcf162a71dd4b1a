"""The sample tables (a star schema and an event table) seen as shop records.

Plain expressions over the parquet files. Day bounds, where given, are put on
the stored columns, so they reach the scan.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.clock import with_log_time
from ..functions.values import masked_phone


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _between(column: str, first: str | None, last: str | None) -> Column:
    """``first`` <= day of ``column`` <= ``last``, as bounds on the column itself."""
    bound = F.lit(True)
    if first is not None:
        bound = bound & (F.col(column) >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        end = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
        bound = bound & (F.col(column) < end)
    return bound


def _text(column) -> Column:
    return F.col(column).cast("string")


def logs(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """App logs of both kinds; five accounts share a device."""
    kind = F.col("event_type")
    events = table(spark, folder, "events").filter(_between("ts", first, last))
    return events.select(
        F.concat(F.lit("mid_"), F.call_function("div", F.col("user_id"), F.lit(5)).cast("string")).alias("mid"),
        _text("user_id").alias("uid"),
        F.lit("app").alias("appid"),
        F.lit("beijing").alias("area"),
        F.lit("ios").alias("os"),
        F.lit("appstore").alias("ch"),
        F.when(kind == "signup", "startup").otherwise("event").alias("type"),
        F.lit("1.2.0").alias("vs"),
        F.when(kind == "purchase", "coupon")
        .when(kind == "click", "clickItem")
        .when(kind == "view", "addCart")
        .when(kind == "error", "addComment")
        .alias("evid"),
        F.get_json_object("props", "$.k").alias("itemid"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )


def startup_log(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    starts = logs(spark, folder, first, last).filter(F.col("type") == "startup")
    return with_log_time(starts).select(*schemas.STARTUP_LOG.fieldNames())


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    rest = logs(spark, folder).filter(F.col("type") == "event")
    pages = rest.withColumns({"pgid": F.lit("1"), "npgid": F.lit("2")})
    return with_log_time(pages).select(*schemas.EVENT_LOG.fieldNames())


def log_json(spark: SparkSession, folder: str, stamped: bool = True) -> DataFrame:
    """Logs of both kinds as text; pages and items are JSON numbers. Without
    ``stamped`` the text has no time yet, as a client sends it. ``sent_at`` is
    the time of the event either way."""
    frame = logs(spark, folder).withColumn("sent_at", F.timestamp_millis("ts"))
    time = ["ts"] if stamped else []
    startup = ["type", "mid", "uid", "os", "appid", "area", "ch", "vs", *time]
    event = ["type", "mid", "uid", "os", "appid", "area", "evid", "pgid", "npgid", "itemid", *time]
    numbered = frame.withColumns(
        {"pgid": F.lit(1), "npgid": F.lit(2), "itemid": F.col("itemid").cast("bigint")}
    )
    text = F.when(F.col("type") == "startup", F.to_json(F.struct(*startup))).otherwise(
        F.to_json(F.struct(*event))
    )
    return numbered.select(text.alias("value"), "sent_at")


def _orders(spark: SparkSession, folder: str, province: bool, first=None, last=None) -> DataFrame:
    orders = table(spark, folder, "orders").filter(_between("o_orderdate", first, last))
    if not province:
        return orders.withColumn("c_nationkey", F.lit(None).cast("int"))
    homes = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return orders.join(homes, "o_custkey")


def _order_columns() -> dict[str, Column]:
    day = F.col("o_orderdate").cast("date").cast("string")
    hour = F.lpad(F.pmod("o_orderkey", F.lit(24)).cast("string"), 2, "0")
    return {
        "id": _text("o_orderkey"),
        "province_id": _text("c_nationkey"),
        "consignee_tel": F.concat(F.lit("1"), F.lpad(_text("o_custkey"), 10, "0")),
        "order_status": F.col("o_orderstatus"),
        "user_id": _text("o_custkey"),
        "total_amount": F.col("o_totalprice"),
        "create_time": F.concat(day, F.lit(" "), hour, F.lit(":00:00")),
        "create_date": day,
        "create_hour": hour,
    }


def order_wire(
    spark: SparkSession, folder: str, province: bool = True, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Orders with all columns as text, as change records carry them."""
    known = _order_columns() | {"total_amount": F.col("o_totalprice").cast("decimal(18,2)").cast("string")}
    missing = F.lit(None).cast("string")
    return _orders(spark, folder, province, first, last).select(
        *[known.get(n, missing).alias(n) for n in schemas.ORDER_WIRE.fieldNames()]
    )


def order_info(
    spark: SparkSession, folder: str, first: str | None = None, last: str | None = None, province: bool = False
) -> DataFrame:
    """Orders as decoding leaves them, straight from the columns."""
    known = _order_columns()
    known["consignee_tel"] = masked_phone(known["consignee_tel"])
    missing = F.lit(None).cast("string")
    return _orders(spark, folder, province, first, last).select(
        *[known.get(n, missing).alias(n) for n in schemas.ORDER_INFO.fieldNames()]
    )


def order_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a second delivery (``seq`` 2, status ``R``) of every fifth."""
    first = order_info(spark, folder).withColumn("seq", F.lit(1))
    again = first.filter(F.col("id").cast("bigint") % 5 == 0)
    return first.unionByName(again.withColumns({"seq": F.lit(2), "order_status": F.lit("R")}))


def order_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of which every fifth comes again (``seq`` 2) a day later, for twice as
    much, and every fifteenth once more (``seq`` 3) in the last hour of its first day."""
    first = order_info(spark, folder).withColumn("seq", F.lit(1))
    key = F.col("id").cast("bigint")
    next_day = F.date_add(F.col("create_date").cast("date"), 1).cast("string")
    moved = first.filter(key % 5 == 0).withColumns(
        {"seq": F.lit(2), "create_date": next_day, "total_amount": F.col("total_amount") * 2}
    )
    back = first.filter(key % 15 == 0).withColumns({"seq": F.lit(3), "create_hour": F.lit("23")})
    return first.unionByName(moved).unionByName(back)


def _detail_columns() -> dict[str, Column]:
    ship = F.replace(F.col("l_shipdate").cast("date").cast("string"), F.lit("-"), F.lit(""))
    return {
        "id": F.concat_ws(
            "-", _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey"), ship
        ),
        "order_id": _text("l_orderkey"),
        "sku_name": F.col("p_name"),
        "sku_id": _text("l_partkey"),
        "order_price": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        "img_url": F.lit(""),
        "sku_num": F.col("l_quantity").cast("bigint").cast("string"),
    }


def _lines(spark: SparkSession, folder: str, sku: bool) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    if not sku:
        return lines.withColumn("p_name", F.lit(None).cast("string"))
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lines.join(names, "l_partkey")


def detail_wire(spark: SparkSession, folder: str, sku: bool = True) -> DataFrame:
    """Order details, all text; product names only where asked for."""
    return _lines(spark, folder, sku).select(*[c.alias(n) for n, c in _detail_columns().items()])


def timed_orders(spark: SparkSession, folder: str) -> DataFrame:
    return order_info(spark, folder).withColumn("order_ts", F.to_timestamp("create_time"))


def timed_details(spark: SparkSession, folder: str) -> DataFrame:
    """Details with an event time: 25 s per line number after their order."""
    days = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = _lines(spark, folder, sku=False).join(days, "l_orderkey")
    seconds = F.pmod("l_orderkey", F.lit(24)) * 3600 + F.col("l_linenumber") * 25
    midnight = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return lines.select(
        *[c.alias(n) for n, c in _detail_columns().items()],
        F.timestamp_seconds(midnight + seconds).alias("detail_ts"),
    )


def customers_as_users(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1950-01-01").cast("date"), F.pmod(key * 7919, F.lit(22000)).cast("int"))
    return table(spark, folder, "customer").select(
        _text("c_custkey").alias("id"),
        F.col("c_name").alias("login_name"),
        F.col("c_mktsegment").alias("user_level"),
        born.cast("string").alias("birthday"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
    )


def user_info(spark: SparkSession, folder: str) -> DataFrame:
    """Users; every tenth customer is left out, as a buyer nobody knows."""
    users = customers_as_users(spark, folder)
    return users.filter(F.col("id").cast("bigint") % 10 != 0)


def user_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Users with a second version (``seq`` 2, other level) of every seventh."""
    first = customers_as_users(spark, folder).withColumn("seq", F.lit(1))
    again = first.filter(F.col("id").cast("bigint") % 7 == 0)
    return first.unionByName(again.withColumns({"seq": F.lit(2), "user_level": F.lit("GOLD")}))


def as_json(frame: DataFrame) -> DataFrame:
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("value"))


def _entries(frame: DataFrame, table_name: str, event_type, entry_type: str = "ROWDATA") -> DataFrame:
    image = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit("")).alias("value"))
            for c in frame.columns
            if c != "seq"
        ]
    )
    return frame.select(
        F.lit(entry_type).alias("entry_type"),
        F.lit(table_name).alias("table_name"),
        (F.lit(event_type) if isinstance(event_type, str) else event_type).alias("event_type"),
        F.lit(0).cast("bigint").alias("ts"),
        F.array(image).alias("rows"),
    )


def cdc(spark: SparkSession, folder: str) -> DataFrame:
    """Change entries: the three tables, and entries the routing must drop.

    Every order is also deleted again, every part row belongs to a table
    nobody asked for, and every supplier stands for a transaction mark.
    """
    orders = order_wire(spark, folder)
    changes = user_changes(spark, folder)
    event = F.when(F.col("seq") == 1, "INSERT").otherwise("UPDATE")
    parts = table(spark, folder, "part").select(_text("p_partkey").alias("id"))
    marks = table(spark, folder, "supplier").select(_text("s_suppkey").alias("id"))
    frames = [
        _entries(orders, "order_info", "INSERT"),
        _entries(orders.select("id"), "order_info", "DELETE"),
        _entries(detail_wire(spark, folder), "order_detail", "INSERT"),
        _entries(changes, "user_info", event),
        _entries(parts, "sku_info", "INSERT"),
        _entries(marks, "order_info", "INSERT", entry_type="TRANSACTIONBEGIN"),
    ]
    entries = frames[0]
    for more in frames[1:]:
        entries = entries.unionByName(more)
    return entries
