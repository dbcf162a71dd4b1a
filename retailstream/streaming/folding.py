"""Folding the versions of a closed day, while readers and jobs go on.

The current rows of the day are written beside the table, and then a note says up to
which version they stand for it. Readers of the latest rows take them together with
the versions that came after; until the note is there they see the versions alone. So a
reader sees each row once at any time, and a late record of the day counts as ever.
Folders that only older readers open can be removed when these are done.
"""

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NOTE = "day string, run string, batch bigint, made string"


def _notes(spark: SparkSession, path: str, days: list[str] | None) -> list:
    """The last note of each folded day, of the ``days`` alone if given; one row per day."""
    place = f"{path.rstrip('/')}_folds"
    folders = place if days is None else f"{place}/{{{','.join(days)}}}"
    try:
        rows = spark.read.schema(_NOTE).option("recursiveFileLookup", "true").parquet(folders).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    last = {}
    for row in sorted(rows, key=lambda r: r.made):
        last[row.day] = row
    return list(last.values())


def _place(path: str, note) -> str:
    return f"{path.rstrip('/')}_folded/{note.day}/{note.made}"


def preferred(versions: DataFrame, path: str, day_column: str, days: list[str] | None) -> DataFrame:
    """Versions of a table, those that a folded day stands for replaced by its rows."""
    notes = _notes(versions.sparkSession, path, days)
    if not notes:
        return versions
    # Folded rows carry the day and the version that they stand for as columns.
    folded = versions.sparkSession.read.schema(versions.schema).parquet(*[_place(path, n) for n in notes])
    known = versions.sparkSession.createDataFrame([(n.day, n.run, n.batch) for n in notes], "_day string, _run string, _batch bigint")
    newer = (F.col("run_id") > F.col("_run")) | ((F.col("run_id") == F.col("_run")) & (F.col("batch_id") > F.col("_batch")))
    later = versions.join(F.broadcast(known), versions[day_column] == known["_day"], "left")  # a row per folded day
    later = later.filter(F.col("_day").isNull() | newer).select(*versions.columns)
    if len(notes) == 1 and days is not None and len(days) == 1:
        # Bounds on the partition columns themselves, so that old folders are pruned.
        run, batch = F.lit(notes[0].run), F.lit(notes[0].batch)
        later = versions.filter((F.col("run_id") > run) | ((F.col("run_id") == run) & (F.col("batch_id") > batch)))
    return folded.select(*versions.columns).unionByName(later)


def fold_day(spark: SparkSession, path: str, schema: StructType, keys: list[str], day_column: str, day: str, newest: tuple[str, ...] = ()) -> None:
    """Fold a day that is closed: its batches so far are done. Can be done again later."""
    from . import sinks

    versions = sinks.read_versions(spark, path, schema, (day_column, [day]))
    last = versions.agg(F.max(F.struct(*sinks.VERSION))).first()[0]
    if last is None:
        return
    # What a batch adds from now on is left to readers.
    upto = F.struct(*sinks.VERSION) <= F.struct(F.lit(last[0]).alias(sinks.RUN), F.lit(last[1]).cast("bigint").alias(sinks.BATCH))
    rows = sinks.latest_per_key(preferred(versions, path, day_column, [day]).filter(upto), [day_column, *keys], [*newest, *sinks.VERSION])
    made = f"{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:8]}"
    note = spark.createDataFrame([(day, last[0], last[1], made)], _NOTE)
    standing = rows.withColumns({sinks.RUN: F.lit(last[0]), sinks.BATCH: F.lit(last[1])})
    standing.hint("rebalance").write.parquet(_place(path, note.first()))
    note.coalesce(1).write.parquet(f"{path.rstrip('/')}_folds/{day}/{made}")


def remove_folded(spark: SparkSession, path: str, day_column: str, day: str) -> None:
    """Remove the folders of a day that its last folding stands for. Readers that began
    before it must be done, and so must the jobs that wrote them."""
    from . import sinks

    for note in _notes(spark, path, [day]):
        old = sinks.read_versions(spark, path, StructType([]), (day_column, [day])).select(*sinks.VERSION).distinct()
        newer = F.struct(*sinks.VERSION) > F.struct(F.lit(note.run).alias(sinks.RUN), F.lit(note.batch).cast("bigint").alias(sinks.BATCH))
        # One row per batch of the day.
        for run, batch in old.filter(~newer).toLocalIterator():
            sinks.remove(spark, f"{path.rstrip('/')}/{day_column}={day}/{sinks.RUN}={run}/{sinks.BATCH}={batch}")
