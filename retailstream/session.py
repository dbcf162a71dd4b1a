"""Session settings the jobs rely on, and the folder executors share."""

from pyspark.sql import SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
TIME_ZONE = "spark.sql.session.timeZone"

# Settings that a job may change at run time. Skewed partitions are split even
# where that costs one more exchange: an unsplit hot partition costs far more.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Settings for streams that keep state: on disk rather than on the heap, with
# only the changes of a batch sent to the shared checkpoint.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepared(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built."""
    for name, value in (RUNTIME_SETTINGS | STATE_SETTINGS).items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("retailstream")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.conf.set(TIME_ZONE, "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    return prepared(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder reachable by every executor, as the cluster names it.

    There is no machine-local fallback on purpose: state kept on one machine
    is lost with it.
    """
    folder = spark.conf.get(_CHECKPOINT_DIR, None)
    if not folder:
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder shared by all executors")
    return folder.rstrip("/")
