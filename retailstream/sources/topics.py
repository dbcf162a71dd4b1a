"""Where raw records come from: one row per record, its text in ``value``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPIC_TABLE = (
    "value STRING, received_at TIMESTAMP, changed_at BIGINT, offset BIGINT, position INT, "
    "topic STRING, run_id STRING, batch_id BIGINT"
)
# What tells which of two records of a key is newer, the first of these first.
ARRIVAL = ("changed_at", "received_at", "offset", "position")


def kafka_options(servers: str, topic: str, starting: str = "latest", max_records: int | None = None) -> dict:
    """Reader options. Offsets live in the query's checkpoint, so a restart goes
    on where it stopped; ``max_records`` keeps a restart from taking the whole
    backlog in one batch."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": "true",
    }
    if max_records is not None:
        options["maxOffsetsPerTrigger"] = str(max_records)
    return options


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", max_records: int | None = None
) -> DataFrame:
    """A topic as a stream. Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").options(**kafka_options(servers, topic, starting, max_records))
    return reader.load().selectExpr(
        "CAST(value AS STRING) AS value", "timestamp AS received_at", "partition", "offset"
    )


def _lines(frame: DataFrame) -> DataFrame:
    return frame.select("value", F.col("_metadata.file_modification_time").alias("received_at"))


def file_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """A folder of text files as a stream, one record per line."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return _lines(reader.load(folder))


def topic_table_stream(spark: SparkSession, path: str, topic: str, max_files: int | None = None) -> DataFrame:
    """One topic of a topic table (see ``streaming.sinks``) as a stream."""
    reader = spark.readStream.schema(TOPIC_TABLE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path).filter(F.col("topic") == topic).select("value", *ARRIVAL)


def topic_table(spark: SparkSession, path: str, topic: str) -> DataFrame:
    rows = spark.read.schema(TOPIC_TABLE).parquet(path)
    return rows.filter(F.col("topic") == topic).select("value", *ARRIVAL)


# As `streaming.jobs.log_topics` and `cdc_topics` write them.
COMMITTED = "value STRING, received_at TIMESTAMP, changed_at BIGINT, offset BIGINT, position INT, topic STRING"


def committed_stream(spark: SparkSession, path: str, topic: str, max_files: int | None = None) -> DataFrame:
    """One topic of committed topics as a stream: each record once, whatever the writer went through."""
    reader = spark.readStream.schema(COMMITTED)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(path).filter(F.col("topic") == topic).select("value", *ARRIVAL)


def committed(spark: SparkSession, path: str, topic: str) -> DataFrame:
    return spark.read.schema(COMMITTED).parquet(path).filter(F.col("topic") == topic).select("value", *ARRIVAL)
