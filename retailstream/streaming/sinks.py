"""Tables that a stream may write over and over without doubling anything.

A table is a parquet folder partitioned by a day (or topic), the run and the
number of the micro-batch. A run is what one checkpoint has seen: its name is
kept with the checkpoint, so a restart goes on with it, and a job with a new
checkpoint, or a second job on the same table, writes beside the others. A batch
that is run again replaces exactly what it wrote before. An upsert adds the new
version of a row; readers take the latest version per key, later runs first. A
micro-batch therefore costs what it brings, not what the day already holds.
``folding.fold_day`` folds the versions of a closed day together, and ``compact`` those
of a whole table into another one.
"""

import time
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.dedup import first_activity, latest_per_key, new_activity
from ..operators.skew import splits_skew
from . import folding

RUN, BATCH = "run_id", "batch_id"
VERSION = (RUN, BATCH)


class Turn(NamedTuple):
    """One micro-batch of a run. Only the ``first`` of a process can be one that
    an earlier process has begun to write."""

    run: str
    number: int
    first: bool = True


def _turn(turn: Turn | int) -> Turn:
    """Batches written by hand belong to run 0, before all others."""
    return turn if isinstance(turn, Turn) else Turn("0", turn)


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The run of a checkpoint, named at its first use; names sort by time."""
    path = f"{checkpoint.rstrip('/')}/run"
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    run = f"{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([(run,)], "value string").coalesce(1).write.text(path)
    return run


def table_columns(frame: DataFrame) -> DataFrame:
    """Upper-case column names, as the SQL fact tables spell them."""
    return frame.toDF(*[c.upper() for c in frame.columns])


def layout(schema: StructType) -> StructType:
    """The columns of a table as they lie in its files and folders."""
    return StructType(list(schema.fields) + [StructField(RUN, StringType()), StructField(BATCH, LongType())])


def create_table(spark: SparkSession, path: str, schema: StructType, partitions: tuple[str, ...] = ()) -> None:
    """Make sure the folder exists, so that it can be read before the first batch."""
    empty = spark.createDataFrame([], layout(schema))
    empty.write.mode("append").partitionBy(*partitions, *VERSION).parquet(path)


def read_versions(
    spark: SparkSession, path: str, schema: StructType, only: tuple[str, list[str]] | None = None
) -> DataFrame:
    """All rows ever written, with their ``run_id`` and ``batch_id``.

    ``only`` names the outermost partition column and the days (or hours)
    wanted. Folders of other days are then not even listed, which counts once a
    table has many batches.
    """
    full = layout(schema)
    if only is None:
        return spark.read.schema(full).parquet(path)
    column, values = only
    folders = f"{path.rstrip('/')}/{column}={{{','.join(values)}}}"
    try:
        return spark.read.schema(full).option("basePath", path).parquet(folders)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)  # nothing written for these days yet


def read_latest(
    spark: SparkSession,
    path: str,
    schema: StructType,
    keys: list[str],
    partitions: tuple[str, ...] = (),
    newest: tuple[str, ...] = (),
    days: list[str] | None = None,
) -> DataFrame:
    """The current rows: per key the version of the latest batch.

    A row keeps its day for good, so the partition columns count as part of
    the key, and a filter on the day prunes partitions through this view.
    ``days`` restricts the reading itself to these days. Of a folded day (``folding``) the
    folded rows stand for all versions up to then.
    """
    versions = read_versions(spark, path, schema, None if days is None else (partitions[0], days))
    if partitions:
        versions = folding.preferred(versions, path, partitions[0], days)
    return latest_per_key(versions, [*partitions, *keys], [*newest, *VERSION]).drop(*VERSION)


def remove(spark: SparkSession, pattern: str) -> None:
    """Remove the folders that a path pattern names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for found in files.globStatus(place) or []:
        files.delete(found.getPath(), True)


def _clear(spark: SparkSession, turn: Turn, path: str, partitions: tuple[str, ...]) -> None:
    """Remove what an earlier try of the batch has left, also in days it no longer has."""
    remove(spark, "/".join([path.rstrip("/"), *["*"] * len(partitions), f"{RUN}={turn.run}", f"{BATCH}={turn.number}"]))


def write_batch(
    batch: DataFrame, turn: Turn | int, path: str, partitions: tuple[str, ...] = (), file_format: str = "parquet"
) -> None:
    """Write the rows of one micro-batch; writing them again changes nothing."""
    turn = _turn(turn)
    rows = batch.withColumns({RUN: F.lit(turn.run), BATCH: F.lit(turn.number).cast("bigint")})
    if turn.first:
        _clear(rows.sparkSession, turn, path, partitions)
    # Rebalancing merges crumbs into full files and splits a day (or topic) that
    # holds most of the rows. Where it could not split, rows stay spread as they are.
    if splits_skew(rows.sparkSession):
        rows = rows.hint("rebalance", *partitions)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions, *VERSION).format(file_format).save(path)


def upsert_batch(
    batch: DataFrame,
    turn: Turn | int,
    path: str,
    keys: list[str],
    partitions: tuple[str, ...] = (),
    newest: tuple[str, ...] = (),
) -> None:
    """Add the last version of each key in the batch, without the ``newest`` columns."""
    write_batch(latest_per_key(batch, keys, list(newest)).drop(*newest), turn, path, partitions)


def remember(spark: SparkSession, turn: Turn, path: str, schema: StructType, values: tuple) -> None:
    """Keep a few numbers of a batch for the next one."""
    write_batch(spark.createDataFrame([values], schema).coalesce(1), turn, path)


def recall(spark: SparkSession, turn: Turn, path: str, schema: StructType) -> tuple | None:
    """What the batch before has remembered; opens its folder and no other."""
    try:
        row = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{RUN}={turn.run}/{BATCH}={turn.number - 1}").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row and tuple(row)


def before(turn: Turn | int):
    """Rows that were there when the batch came: all but its own, from an earlier try."""
    turn = _turn(turn)
    return (F.col(RUN) != turn.run) | (F.col(BATCH) < turn.number)


def add_new_activity(batch: DataFrame, turn: Turn | int, path: str, schema: StructType) -> None:
    """Add the devices of a batch that have no row for their day yet."""
    spark, turn = batch.sparkSession, _turn(turn)
    first = first_activity(batch).persist()
    try:
        # One value per day in the batch; keeps the look-up to those days' partitions.
        days = [row.logDate for row in first.select("logDate").distinct().toLocalIterator()]
        seen = read_versions(spark, path, schema, ("logDate", days)).filter(before(turn))
        write_batch(new_activity(first, seen), turn, path, ("logDate",))
    finally:
        first.unpersist()


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    schema: StructType,
    keys: list[str],
    partitions: tuple[str, ...] = (),
    newest: tuple[str, ...] = (),
) -> None:
    """Write the current rows of ``source`` to the table ``target``, as its batch -1."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("compact into another folder; the source stays readable meanwhile")
    write_batch(read_latest(spark, source, schema, keys, partitions, newest), -1, target, partitions)


def kafka_sink(routed: DataFrame, servers: str):
    """Stream writer that publishes ``(topic, value)``. Needs the Kafka connector."""
    return (
        routed.select("topic", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
    )


def kafka_topics(servers: str):
    """The same for the rows of one micro-batch, as a sink of the routing jobs."""

    def write(routed: DataFrame, turn: Turn | int) -> None:
        rows = routed.select("topic", "value").write.format("kafka")
        rows.option("kafka.bootstrap.servers", servers).save()

    return write


def topic_table_sink(path: str):
    """Routed records into a topic table, with all that tells their order."""

    def write(routed: DataFrame, turn: Turn | int) -> None:
        none = {"changed_at": "bigint", "offset": "bigint", "position": "int"}
        full = routed.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in routed.columns})
        write_batch(full.select("value", "received_at", *none, "topic"), turn, path, ("topic",))

    return write
