"""What several operators share: tables, cut lineage, splits of learning rows."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

# The words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder of the context, set from the session where it is unset.

    Only a local session may do without a named folder; it takes a temporary one.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        local = context.master == "local" or context.master.startswith("local[")
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir((named or tempfile.mkdtemp()) if local else shared_folder(spark))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, kept in the folder that all executors share; for narrow rows."""
    _shared(frame.sparkSession)
    return frame.checkpoint()


def gathered(frame: DataFrame, rows: int) -> DataFrame:
    """`checkpointed`, and read in tasks of about so many rows, however many wrote it."""
    kept = checkpointed(frame)
    return in_tasks(kept, kept.count() // rows + 1)


def in_tasks(frame: DataFrame, tasks: int) -> DataFrame:
    """The frame, read in so many tasks at most; what fits in one goes to all tasks of a join."""
    return F.broadcast(frame.coalesce(1)) if tasks == 1 else frame.coalesce(tasks)


def stored(frame: DataFrame) -> DataFrame:
    """The frame, written as Parquet to that folder and read again; for texts."""
    path = f"{_shared(frame.sparkSession)}/{uuid.uuid4().hex}.parquet"
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts
