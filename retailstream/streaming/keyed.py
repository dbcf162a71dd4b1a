"""Tables that micro-batches look up by key: buckets of the key's hash, in generations.

A lookup reads the buckets of its keys and lists no other folders. What a generation
has at its first batch is the whole table, and each later batch adds the rows that it
changes; so the newest generation says all, and a lookup meets at most ``every``
small folders per bucket. A generation counts once its first batch is written whole:
its name then goes to a list beside the table. Readers that come while it is being
written take the one before.

One job at a time writes such a table. A job with a new checkpoint begins with what the
last one has left.
"""

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.dedup import latest_per_key
from . import sinks

BUCKETS = 32
EVERY = 200  # batches of a generation
FOLD, BUCKET = "fold", "bucket"


class Keyed(NamedTuple):
    """A table with one current row per ``keys``."""

    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = BUCKETS
    every: int = EVERY


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _layout(table: Keyed) -> StructType:
    return StructType([*table.schema.fields, StructField(FOLD, StringType()), StructField(BUCKET, IntegerType())])


def _list(table: Keyed) -> str:
    return f"{table.path.rstrip('/')}_generations"


def _name(table: Keyed, turn: sinks.Turn) -> str:
    """Names sort by time and tell the number of buckets, so that may change from one to the next."""
    return f"{turn.run}-{turn.number // table.every:08d}-{table.buckets:05d}"


def _begins(table: Keyed, turn: sinks.Turn) -> bool:
    return turn.number % table.every == 0


def generations(spark: SparkSession, table: Keyed) -> list[str]:
    """Names of the generations that are whole, in order of time."""
    try:
        return sorted(row.value for row in spark.read.text(f"{_list(table)}/*").distinct().collect())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _read(spark: SparkSession, table: Keyed, name: str | None, buckets: list[int] | None = None) -> DataFrame:
    """All rows of a generation, of certain buckets only if these are given."""
    if name is None or buckets == []:
        return spark.createDataFrame([], sinks.layout(_layout(table)))
    folder = f"{table.path.rstrip('/')}/{FOLD}={name}"
    if buckets is not None:
        folder = f"{folder}/{BUCKET}={{{','.join(map(str, buckets))}}}"
    try:
        return spark.read.schema(sinks.layout(_layout(table))).option("basePath", table.path).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return _read(spark, table, None)


def _latest(rows: DataFrame, table: Keyed) -> DataFrame:
    return latest_per_key(rows, list(table.keys), list(sinks.VERSION)).select(*table.schema.fieldNames())


def read(spark: SparkSession, table: Keyed) -> DataFrame:
    """The current rows, one per key."""
    names = generations(spark, table)
    return _latest(_read(spark, table, names[-1] if names else None), table)


def lookup(wanted: DataFrame, table: Keyed, turn: sinks.Turn | None = None) -> DataFrame:
    """The current rows of the keys in ``wanted``; with ``turn`` those before that batch."""
    spark = wanted.sparkSession
    if turn is not None and not _begins(table, turn):
        name, earlier = _name(table, turn), sinks.before(turn)
    else:
        names = [n for n in generations(spark, table) if turn is None or n < _name(table, turn)]
        name, earlier = names[-1] if names else None, F.lit(True)
    if name is None:
        return _latest(_read(spark, table, None), table)
    held = int(name.rsplit("-", 1)[1])
    keys = wanted.select(*table.keys).distinct()
    # As many numbers as there are buckets at most.
    buckets = sorted(r[0] for r in keys.select(bucket_of(table.keys, held)).distinct().collect())
    rows = _read(spark, table, name, buckets).filter(earlier)
    return _latest(rows.join(keys, list(table.keys), "left_semi"), table)


def upsert(batch: DataFrame, turn: sinks.Turn, table: Keyed, newest: tuple[str, ...] = ()) -> None:
    """Add the last version of each key in the batch. Doing it again changes nothing."""
    spark, name = batch.sparkSession, _name(table, turn)
    rows = latest_per_key(batch, list(table.keys), list(newest)).select(*table.schema.fieldNames())
    begins = _begins(table, turn)
    if begins:
        names = [n for n in generations(spark, table) if n < name]
        old = _latest(_read(spark, table, names[-1] if names else None), table)
        rows = old.join(rows.select(*table.keys), list(table.keys), "left_anti").unionByName(rows)
    placed = rows.withColumns({FOLD: F.lit(name), BUCKET: bucket_of(table.keys, table.buckets)})
    sinks.write_batch(placed, turn, table.path, (FOLD, BUCKET))
    if begins:
        spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{_list(table)}/{name}")


def outdated(spark: SparkSession, table: Keyed, keep: int = 2) -> list[str]:
    """Folders of generations that no reader opens any more, but for the last ``keep``."""
    return [f"{table.path.rstrip('/')}/{FOLD}={name}" for name in generations(spark, table)[:-keep]]
