"""Ingest by file: reruns touch nothing, a late change touches its partitions only, a failure is done again."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tickloom.artifacts import Store
from tickloom.session import scratch_path
from tickloom.sources import ingest as ig

SCHEMA = "date date, symbol string, close double"


def read(spark, paths):
    return spark.read.schema(SCHEMA).csv(list(paths))


def land(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)
    later = time.time() + land.tick
    land.tick += 2  # file times differ even where the clock does not
    os.utime(f"{folder}/{name}", (later, later))


land.tick = 0


@pytest.fixture
def place(spark):
    base = scratch_path(spark, "ingest")
    store = Store(spark, f"{base}/store")
    folder, table = f"{base}/files", f"{base}/table"
    run = lambda reader=read: {r["part"]: (r["n_files"], r["action"]) for r in ig.ingest(spark, folder, table, store, "bars", reader).collect()}
    rows = lambda: sorted((str(r["date"]), r["symbol"], r["close"]) for r in ig.stored(spark, table).collect())
    return folder, run, rows


def test_runs(place):
    folder, run, rows = place
    assert run() == {}
    land(folder, "a.csv", "2024-01-05,x,1.0\n2024-02-01,x,2.0\n")
    land(folder, "b 1+.csv", "2024-02-02,y,3.0\n,y,9.0\n")
    land(folder, "blank.csv", "")
    assert run() == {"2024-01": (1, "rewritten"), "2024-02": (2, "rewritten")}
    first = rows()
    assert first == [("2024-01-05", "x", 1.0), ("2024-02-01", "x", 2.0), ("2024-02-02", "y", 3.0)]
    assert run() == {} and rows() == first
    land(folder, "c.csv", "2024-03-01,z,4.0\n")
    assert run() == {"2024-03": (1, "rewritten")}
    # a correction moves a row to another month: both months are rewritten, from all files that feed them
    land(folder, "a.csv", "2024-01-05,x,1.5\n2024-03-02,x,2.5\n")
    assert run() == {"2024-01": (1, "rewritten"), "2024-02": (1, "rewritten"), "2024-03": (2, "rewritten")}
    assert rows() == [("2024-01-05", "x", 1.5), ("2024-02-02", "y", 3.0), ("2024-03-01", "z", 4.0), ("2024-03-02", "x", 2.5)]
    os.remove(f"{folder}/b 1+.csv")
    assert run() == {"2024-02": (0, "removed")}
    assert [r[0] for r in rows()] == ["2024-01-05", "2024-03-01", "2024-03-02"]


def test_a_failed_run_is_done_again(place):
    folder, run, rows = place
    land(folder, "a.csv", "2024-01-05,x,1.0\n")
    run()
    land(folder, "b.csv", "2024-01-06,x,2.0\n")
    lost = lambda s, p: read(s, p).withColumn("close", F.when(F.col("close") > 1, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):
        run(lost)
    assert rows() == [("2024-01-05", "x", 1.0)]
    assert run() == {"2024-01": (2, "rewritten")} and len(rows()) == 2
