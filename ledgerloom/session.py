"""Session settings, shared work folders and input spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs are designed for. Anything already set by the cluster wins.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small shuffled partitions are joined by hash instead of by sorting.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # A skewed join is split even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Larger generated methods are never compiled by the JVM; smaller ones are.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Streaming deduplication keeps its keys on disk instead of on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

#: Setting with the number of partitions for ``spread``; without it the cores decide.
SPREAD = "spark.ledgerloom.spread"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(SPREAD, str(shuffle_partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without it, because there the driver and the
    executors share one disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.gettempdir() + "/ledgerloom"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root; nothing in it is ever overwritten by another run."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write an intermediate result to the shared work folder and read it back.

    Several branches use it. Written once, it is not computed again for each
    branch or after the loss of an executor, and each branch reads its columns only.
    """
    path = work_dir(df.sparkSession, name)
    df.write.partitionBy(*([partition_by] if partition_by else [])).parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that lies in few files to more tasks before CPU-bound row work.

    The number of partitions is a setting of the session (``SPREAD``). Without it a table
    of fewer partitions than two per core, which would leave cores idle, is dealt to four per core.
    """
    partitions = df.sparkSession.conf.get(SPREAD, None)
    if partitions:
        return df.repartition(int(partitions))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df
