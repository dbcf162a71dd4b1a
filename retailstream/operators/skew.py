"""Joins that stay even when one key holds a large part of the rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot if it alone fills this part of an even shuffle partition. At most
# partitions / part keys can be, whatever the data.
HOT_PART = 0.25


def splits_skew(spark: SparkSession) -> bool:
    """Whether Spark itself splits skewed join partitions at run time.

    It does by default in batch jobs and in micro-batches of stateless streams,
    and does not in those of stateful ones.
    """
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(name).lower() == "true" for name in names)


def hot_keys(frame: DataFrame, key: str, partitions: int) -> DataFrame:
    """Keys frequent enough to unbalance a shuffle into so many partitions.

    Decided by their share of all rows, which bounds their number by itself.
    Reads only the key column, and counts before the exchange. The result
    steers where rows go, never which rows come out.
    """
    counts = frame.filter(F.col(key).isNotNull()).groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.filter(F.col("count") > total * HOT_PART / partitions).select(key)


def join_unique(rows: DataFrame, unique: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``unique`` (one row per ``key``), ``how`` inner or left.

    Left to Spark, which broadcasts ``unique`` when its own size check allows
    and otherwise splits partitions that turn out skewed. In sessions where it
    does not split them, ``join_dealt`` takes over.
    """
    if splits_skew(rows.sparkSession):
        return rows.join(unique, key, how)
    return join_dealt(rows, unique, key, spread_by, how)


def join_dealt(
    rows: DataFrame,
    unique: DataFrame,
    key: str,
    spread_by: str,
    how: str = "inner",
    parts: int | None = None,
) -> DataFrame:
    """The same join with hot keys dealt out over ``parts`` by hand.

    Rows of a hot key, and rows without a key, go to a part by the hash of
    ``spread_by``; of ``unique`` only the few hot rows are repeated. The hash
    depends on the row alone, so a task that is run again deals the same way.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no {how!r} joins here: only the side with many rows per key can be dealt out")
    if parts is None:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # At most parts / HOT_PART keys, the same ones for both sides.
    few = [row[0] for row in hot_keys(rows, key, parts).collect()]
    kind = rows.select(key).schema
    hot = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in few], kind).withColumn("_hot", F.lit(True)))
    dealt = F.pmod(F.xxhash64(spread_by), F.lit(parts)).cast("int")
    left = rows.join(hot, key, "left").withColumn(
        "_part", F.when(F.col("_hot") | F.col(key).isNull(), dealt).otherwise(0)
    )
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    right = unique.join(hot, key, "left").withColumn(
        "_part", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))
    )
    return left.drop("_hot").join(right.drop("_hot"), [key, "_part"], how).drop("_part")
