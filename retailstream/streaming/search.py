"""Tables that a search over sale details opens in place of the details themselves.

* Postings by day and word: the sale detail job adds the words of what it writes, and
  takes back those of earlier versions. A search opens the buckets of its words.
* Sorted days: the details of a day in the order of their ids, cut into parts, with a
  directory of counts and bounds. A page opens the parts that hold it, however deep it
  is, and so does a look-up of some ids.

Sorting a day again replaces it at once: its parts have a name of their own, and the
directory, which is written last, tells which ones count.
"""

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators import postings
from ..schemas import SALE_DETAIL
from . import keyed, sinks

KEY, DAY, NAME = "order_detail_id", "dt", "sku_name"
BUCKETS = 16
PART_ROWS = 200_000

POSTING = StructType([
    StructField(KEY, StringType()), StructField("word", StringType()), StructField("sign", LongType()),
    StructField(DAY, StringType()), StructField("bucket", IntegerType()),
])
# What later versions of a detail have to take back.
NAMED = StructType([StructField(KEY, StringType()), StructField(DAY, StringType()), StructField(NAME, StringType())])
_ENTRY = "part int, first string, last string, n bigint, made string"


def _postings_path(path: str) -> str:
    return f"{path.rstrip('/')}_postings"


def _names(path: str) -> keyed.Keyed:
    return keyed.Keyed(f"{path.rstrip('/')}_names", NAMED, (KEY,))


def create(spark: SparkSession, path: str) -> None:
    sinks.create_table(spark, _postings_path(path), POSTING, (DAY, "bucket"))


def add_postings(sales: DataFrame, turn: sinks.Turn, path: str) -> None:
    """The words of the details that a batch adds to the table at ``path``, one row per id."""
    names = _names(path)
    had = keyed.lookup(sales, names, turn)
    of = lambda rows: postings.postings(rows, KEY, NAME, (DAY,))
    rows = postings.changed(of(sales), of(had)).withColumn("bucket", postings.word_bucket(F.col("word"), BUCKETS))
    sinks.write_batch(rows.select(*POSTING.fieldNames()), turn, _postings_path(path), (DAY, "bucket"))
    keyed.upsert(sales, turn, names)


def _opened(spark: SparkSession, path: str, day: str, wanted: list[str]) -> DataFrame:
    """Postings of a day in the buckets of the words."""
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(postings.word_bucket(F.col("w"), BUCKETS)).distinct().collect()]
    pattern = f"{_postings_path(path)}/{DAY}={day}/bucket={{{','.join(map(str, sorted(buckets)))}}}"
    full = sinks.layout(POSTING)
    try:
        return spark.read.schema(full).option("basePath", _postings_path(path)).parquet(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def hit_ids(spark: SparkSession, path: str, day: str, keyword: str) -> DataFrame:
    """``(order_detail_id)`` of the details of a day whose name has every word of ``keyword``."""
    wanted = postings.wanted_words(spark.range(1), keyword)
    if not wanted:
        return spark.createDataFrame([], POSTING).select(KEY)
    return postings.having_all(_opened(spark, path, day, wanted), wanted, KEY)


# -- sorted days --------------------------------------------------------------


def sort_day(sales: DataFrame, path: str, day: str, part_rows: int = PART_ROWS) -> None:
    """Write the details of a closed day (one row per id) in the order of their ids."""
    own = sales.filter(F.col(DAY) == day).select(*SALE_DETAIL.fieldNames())
    parts = max(1, -(-own.count() // part_rows))
    made = f"{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path.rstrip('/')}/made={made}"
    placed = own.repartitionByRange(parts, KEY).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", KEY)
    placed.write.partitionBy("part").parquet(folder)
    # Counts come from what has been written, so a task that ran twice does no harm.
    kept = own.sparkSession.read.option("basePath", folder).parquet(folder)
    entries = kept.groupBy(F.col("part").cast("int").alias("part")).agg(
        F.min(KEY).alias("first"), F.max(KEY).alias("last"), F.count("*").alias("n")).withColumn("made", F.lit(made))
    entries.coalesce(1).write.parquet(f"{path.rstrip('/')}_directory/{DAY}={day}/made={made}")


def directory(spark: SparkSession, path: str, day: str) -> list:
    """``(part, first, last, n, made)`` of a sorted day, in order; a row per PART_ROWS details.

    The list of a day is what its reader goes by, like a list of its files.
    """
    try:
        rows = spark.read.schema(_ENTRY).parquet(f"{path.rstrip('/')}_directory/{DAY}={day}").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    newest = max((r.made for r in rows), default=None)
    return sorted((r for r in rows if r.made == newest), key=lambda r: r.part)


def _parts(spark: SparkSession, path: str, entries: list) -> DataFrame:
    if not entries:
        return spark.createDataFrame([], SALE_DETAIL)
    folder = f"{path.rstrip('/')}/made={entries[0].made}"
    # Files do not hold `part`; without a base path it is no column either.
    return spark.read.schema(SALE_DETAIL).parquet(*[f"{folder}/part={e.part}" for e in entries])


def sorted_page(spark: SparkSession, path: str, day: str, number: int, size: int) -> DataFrame:
    """The ``number``-th page (from 1) of a sorted day in order of the id; opens the parts that hold it."""
    skip, chosen, before = (number - 1) * size, [], 0
    for entry in directory(spark, path, day):
        if before < skip + size and before + entry.n > skip:
            chosen.append((before, entry))
        before += entry.n
    rest = skip - chosen[0][0] if chosen else 0
    return _parts(spark, path, [e for _, e in chosen]).orderBy(KEY).offset(rest).limit(size)


def fetch(spark: SparkSession, path: str, day: str, ids: list[str]) -> DataFrame:
    """Details of a sorted day by their ids; opens the parts that can have them."""
    entries = directory(spark, path, day)
    chosen = [e for e in entries if any(e.first <= i <= e.last for i in ids)]
    return _parts(spark, path, chosen).filter(F.col(KEY).isin(ids))


def search(spark: SparkSession, sales_path: str, sorted_path: str, day: str, keyword: str, number: int = 1, size: int = 10) -> dict:
    """``total`` (a number) and ``detail`` (a page of details) of a search over a sorted day.

    Without a keyword the directory has the total; with one, the postings have the ids
    of all hits, and the page looks up its own.
    """
    if not keyword.strip():
        total = sum(e.n for e in directory(spark, sorted_path, day))
        return {"total": total, "detail": sorted_page(spark, sorted_path, day, number, size)}
    hits = hit_ids(spark, sales_path, day, keyword).persist()
    try:
        ids = [r[0] for r in hits.orderBy(KEY).offset((number - 1) * size).limit(size).collect()]
        return {"total": hits.count(), "detail": fetch(spark, sorted_path, day, ids).orderBy(KEY)}
    finally:
        hits.unpersist()
