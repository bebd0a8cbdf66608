"""Session construction and the one place that decides where checkpoints live."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tickloom


def local_session(cores: str = "8", shuffle_partitions: int = 8, driver_memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickloom")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The local test tables are tiny; without this one task would run every window.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only when the session names none (tests, bench: one local JVM) is a fresh local folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="tickloom-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _local_dirs[sc.applicationId]


def ship_package() -> None:
    """Serialise this package's functions and classes by value, so Python workers need no installed copy of it.

    Unlike an added archive this also reaches the worker that sets up a streaming state processor.
    """
    cloudpickle.register_pickle_by_value(tickloom)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in this application's own sub-folder, which can be removed once the application has ended."""
    return f"{shared_dir(spark).rstrip('/')}/tickloom-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table that several later steps read, and return the written table.

    It lives in the shared folder, so a lost executor costs a re-read and not a recomputation of the chain above.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
