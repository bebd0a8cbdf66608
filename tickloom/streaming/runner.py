"""Runs a streaming frame over everything that has landed and returns what it appended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def drain(stream: DataFrame, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """Process all available input in append mode into a parquet sink (exactly once) and read the sink back.

    Passing the same checkpoint and sink again resumes strictly after what was processed before.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = scratch_path(spark, "stream")
    checkpoint, sink = checkpoint or f"{base}/checkpoint", sink or f"{base}/sink"
    q = (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def cuts(df: DataFrame, order: str, n: int) -> list:
    """Values of a column that cut a table into n parts of about equal size, oldest first."""
    at = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(F.col(order), at).alias("c")).first()["c"] or []
    return sorted(set(found))


def drain_in_turn(df: DataFrame, order: str, build: Callable[[DataFrame], DataFrame], n: int = 4, edges: Sequence | None = None) -> DataFrame:
    """Lands a table in n parts (or cut after the given edges), oldest first, and runs the stream that `build` makes once after each.

    A run takes what has landed as one micro-batch and stops; the next resumes from its checkpoint with the state it
    left. Rows of one value of `order` land together. Returns what all runs appended.
    """
    spark, base = df.sparkSession, scratch_path(df.sparkSession, "landing")
    df = cut_lineage(df)
    edges, out = list(edges or cuts(df, order, n)), None
    for i in range(len(edges) + 1):
        part = df if not edges else df.where(F.col(order) <= F.lit(edges[0])) if i == 0 else df.where(F.col(order) > F.lit(edges[i - 1]))
        if 0 < i < len(edges):
            part = part.where(F.col(order) <= F.lit(edges[i]))
        part.write.mode("append").parquet(f"{base}/files")
        out = drain(build(file_stream(spark, f"{base}/files", df.schema)), f"{base}/checkpoint", f"{base}/sink")
    return out
