"""Idempotent ingest of landed files into a partitioned table.

A manifest says which files (by path, time of change and length) have fed which partitions. A run reads the files that
are new or changed, finds the partitions that they, or files that are gone, have a part in, and rewrites just those from
all files that feed them. Running again without a change in the folder touches nothing; a run that failed half way has
not moved the manifest, so the next one does its work again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.artifacts import Store
from tickloom.session import cut_lineage

_MANIFEST = "path string, modified timestamp, length long, part string"
#: Readers take a list of files and give rows with a `date`.
Reader = Callable[[SparkSession, Sequence[str]], DataFrame]


def month(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def _place(path: Column, encoded: bool = False) -> Column:
    """One spelling of a file's path: readers name files with three slashes and escapes, listings with one and none."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(plain, "^([a-z0-9]+):/+", "$1:/")


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, length of every file under a folder; contents are not read. An absent folder has no files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, modified timestamp, length long")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(_place(F.col("path")).alias("path"), F.col("modificationTime").alias("modified"), "length").where("length > 0")


def ingest(spark: SparkSession, folder: str, table: str, store: Store, name: str, read: Reader, part: Column | None = None) -> DataFrame:
    """Brings a table up to date with a folder; returns (part, n_files, action) of the partitions that it rewrote or removed.

    The table is partitioned by `part` (by default the month of `date`). Rows without a date are not stored. Files
    without rows (blank marker files) are remembered, so they are not read again.
    """
    part = (month() if part is None else part).alias("part")
    now = cut_lineage(landed_files(spark, folder))
    known = cut_lineage(store.table(name, "manifest")) if store.current(name) else spark.createDataFrame([], _MANIFEST)
    fresh = now.join(known, ["path", "modified", "length"], "left_anti").select("path")
    changed = [r["path"] for r in fresh.collect()]  # names of what has landed since the last run
    stale = known.join(now, ["path", "modified", "length"], "left_anti")

    def rows(paths: Sequence[str]) -> DataFrame:
        d = read(spark, paths).withColumn("_file", _place(F.input_file_name(), True))
        return d.where("date IS NOT NULL").select("*", part)

    none = spark.createDataFrame([], "path string, part string")
    news_rows = cut_lineage(rows(changed)) if changed else None  # files that landed are read once
    feeds = cut_lineage(news_rows.select(F.col("_file").alias("path"), "part").distinct()) if changed else none
    touched = cut_lineage(feeds.select("part").union(stale.where("part IS NOT NULL").select("part")).distinct())
    kept = known.join(now, ["path", "modified", "length"], "left_semi")
    old = kept.join(touched, "part", "left_semi").select("path").distinct()
    others = [r["path"] for r in old.collect()]
    parts = [r["part"] for r in touched.collect()]  # partitions of this run
    written = set()
    if parts and (changed or others):
        again = rows(others).join(touched, "part", "left_semi") if others else None
        d = again if news_rows is None else news_rows if again is None else news_rows.unionByName(again)
        d = cut_lineage(d.drop("_file"))
        written = {r["part"] for r in d.select("part").distinct().collect()}
        d.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in set(parts) - written:  # nothing feeds them any more
        path = fs.Path(f"{table}/part={p}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    marks = now.join(spark.createDataFrame([(x,) for x in changed], "path string"), "path", "left_semi")
    news = marks.join(feeds, "path", "left").select("path", "modified", "length", "part")
    if changed or not stale.isEmpty():
        store.publish(name, tables={"manifest": cut_lineage(kept.unionByName(news))})
    n = store.table(name, "manifest").groupBy("part").agg(F.count(F.lit(1)).alias("n_files")) if store.current(name) else none.groupBy("part").count()
    done = touched.join(n, "part", "left")
    return cut_lineage(done.select("part", F.coalesce(n.columns[1], F.lit(0)).alias("n_files"), F.when(F.col("part").isin(list(written)), "rewritten").otherwise("removed").alias("action")))


def stored(spark: SparkSession, table: str) -> DataFrame:
    """The ingested rows without the partition column."""
    return spark.read.parquet(table).drop("part")
