"""Spark session defaults and the shared folder for stage tables."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"

# Settings the library relies on; a cluster may raise the sizes.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods above this size; Spark then splits them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# For the network tables. Packets and sessions take some 20 times the memory in a
# sort that they take in a compressed shuffle. Files that cannot be split share a
# task up to the second size: JSON numbers kept as text are read several times.
PACKET_DEFAULTS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.files.maxPartitionBytes": "32m",
}
# A job's shuffles go when it ends, not when the driver collects its garbage.
CLEANUP_DEFAULTS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Of digests in hexadecimal, which most rows hold, this keeps a little over half.
COMPRESSION = "zstd"
# A shuffle begins with a partition for so much of the stored input, as Spark
# merges small partitions but leaves large ones; some 50,000 packets or flow rows.
SHUFFLE_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
EVENTS_PARTITION_BYTES = 1 << 20
FLOWS_PARTITION_BYTES = 4 << 20
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app_name: str = "packetlake", **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` keys override them."""
    builder = SparkSession.builder.appName(app_name)
    settings = {**SQL_DEFAULTS, **PACKET_DEFAULTS, **CLEANUP_DEFAULTS, STATE_STORE_CONF: ROCKSDB_PROVIDER, **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_sql_defaults(spark: SparkSession, **more: str) -> None:
    """Put the runtime SQL settings on a session somebody else created."""
    for key, value in {**SQL_DEFAULTS, **more}.items():
        spark.conf.set(key, value)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``, 0 where there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(place).getLength() if fs.exists(place) else 0


def size_shuffles(spark: SparkSession, partitions: int) -> None:
    """Begin shuffles with ``partitions``, at least with the session's number."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(SHUFFLE_CONF, str(max(least, partitions)))


def ship_package() -> None:
    """Send this package's Python functions to the workers by value, where it
    is not installed for them or passed with ``--py-files``."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it.

    ``spark.checkpoint.dir`` first, then the context's checkpoint folder; where
    neither is set, a folder below the warehouse, which is shared as well.
    """
    folder = (
        spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    )
    if not folder:
        folder = spark.conf.get(WAREHOUSE_CONF).rstrip("/") + "/packetlake-shared"
    return folder.rstrip("/")


def store_stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value
    of the columns ``by``, and read it back.

    Later jobs then scan only the columns they need, and a lost executor costs
    a re-read rather than the whole lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path, compression=COMPRESSION)
    stored = spark.read.parquet(path)
    stored.stage_paths = [path]
    return stored


def drop_stages(*stages: DataFrame) -> None:
    """Delete the files of stored stages that nothing reads any more. Frames
    derived from them must have been stored before; others are left alone."""
    for stage in stages:
        for path in getattr(stage, "stage_paths", ()):
            context = stage.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
