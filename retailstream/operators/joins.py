"""Orders, their details, and the users who placed them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import age_in_years, as_price
from .skew import join_unique


def match_sides(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Full outer match on the order id: ``(order_id, order_detail_id, side)``.

    ``side`` is ``both``, ``order`` (no details) or ``detail`` (no order).
    ``orders`` has one row per id. The full outer join is put together from a
    left join of the details and the orders nobody refers to: a full outer
    join could not split an order with very many details over several tasks.
    """
    lines = details.select("order_id", F.col("id").alias("order_detail_id"))
    known = orders.select(F.col("id").alias("order_id"))
    from_details = join_unique(
        lines, known.withColumn("_found", F.lit(True)), "order_id", "order_detail_id", "left"
    ).select(
        "order_id", "order_detail_id", F.when(F.col("_found"), "both").otherwise("detail").alias("side")
    )
    referred = lines.select("order_id").distinct()
    from_orders = known.join(referred, "order_id", "left_anti").select(
        "order_id", F.lit(None).cast("string").alias("order_detail_id"), F.lit("order").alias("side")
    )
    return from_details.unionByName(from_orders)


def within_wait(
    orders: DataFrame, details: DataFrame, wait_seconds: int = 100, how: str = "inner", parts: int = 1
) -> DataFrame:
    """Orders and details of the same order at most ``wait_seconds`` apart.

    ``orders`` brings ``order_ts``, ``details`` brings ``detail_ts``; both
    bounds are inclusive. On streams both sides need a watermark, which also
    tells Spark when to forget rows that found no partner; ``how='full_outer'``
    emits those at that moment. ``parts`` greater than 1 deals the details of
    each order over that many tasks and repeats the order for each of them
    (``inner`` only), for orders with extremely many details.
    """
    if parts < 1 or (parts > 1 and how != "inner"):
        raise ValueError("parts needs an inner join and a positive number")
    wait = F.expr(f"INTERVAL {int(wait_seconds)} SECONDS")
    o, d = orders.alias("o"), details.alias("d")
    near = F.col("d.detail_ts").between(F.col("o.order_ts") - wait, F.col("o.order_ts") + wait)
    same = F.col("o.id") == F.col("d.order_id")
    if parts > 1:
        o = orders.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).alias("o")
        d = details.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).alias("d")
        same = same & (F.col("o._part") == F.col("d._part"))
    return o.join(d, same & near, how)


_ORDER_COLUMNS = {
    "order_id": "id",
    "order_status": "order_status",
    "create_time": "create_time",
    "dt": "create_date",
    "user_id": "user_id",
}


def order_part(orders: DataFrame) -> DataFrame:
    """The columns a sale detail takes from its order."""
    return orders.select(*[F.col(src).alias(name) for name, src in _ORDER_COLUMNS.items()])


def detail_part(details: DataFrame) -> DataFrame:
    """The columns a sale detail takes from the order detail."""
    return details.select(
        F.col("id").alias("order_detail_id"),
        "order_id",
        "sku_id",
        "sku_name",
        as_price("order_price").alias("sku_price"),
    )


def user_part(users: DataFrame, as_of) -> DataFrame:
    """The columns a sale detail takes from the user; age at ``as_of``."""
    return users.select(
        F.col("id").alias("user_id"),
        F.col("gender").alias("user_gender"),
        age_in_years("birthday", as_of).alias("user_age"),
        "user_level",
    )


def with_user(orders: DataFrame, users: DataFrame, as_of, spread_by: str = "order_id") -> DataFrame:
    """Add the user columns by ``user_id``. Without a user the age stays 0 and
    the rest NULL. ``users`` has one row per id."""
    joined = join_unique(orders, user_part(users, as_of), "user_id", spread_by, "left")
    return joined.withColumn("user_age", F.coalesce("user_age", F.lit(0)))
