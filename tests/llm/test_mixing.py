import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of, rows_of
from tickloom.llm import mixing as M


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by cutting and sharing anew, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: share * sum(sizes.values()) * w[s] / sum(w.values()) for s in names}
    for _ in range(100):
        over = {s for s in names if target[s] > most * sizes[s]}
        spare = sum(target[s] - most * sizes[s] for s in over)
        target.update({s: most * sizes[s] for s in over})
        free = [s for s in names if target[s] < most * sizes[s]]
        if not spare or not free:
            break
        for s in free:
            target[s] += spare * w[s] / sum(w[s] for s in free)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 50, "c": 7, "é": 200, None: 30}, {"x": 0, "y": 5}, {None: 8}, {"x": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in M.source_targets(rows).collect()}
    want = fill(sizes)
    assert {s: round(v, 6) for s, v in got.items()} == {s: round(v, 6) for s, v in want.items()}


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)] + [(3000, None, "a"), (3001, "x", None), (None, "y z", "b"), (5, "again", "a")]
    docs = docs_of(spark, rows).withColumn("rate", F.lit(9)).withColumn("target", F.lit("t"))
    got = M.mix(docs)
    first = rows_of(got)
    assert first == rows_of(M.mix(docs.repartition(7)))
    assert len(first) == len(rows)
    by_source = M.mix(docs).join(docs.select("doc_id", "source").dropDuplicates(["doc_id"]), "doc_id").groupBy("source")
    for r in by_source.agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert r["over"] <= 0
        if r["source"] is not None:
            assert abs(r["taken"] - r["target"]) < 0.06 * r["target"]
    emitted = M.mixed_documents(docs)
    assert emitted.columns == docs.columns
    words = emitted.select(F.sum(M.word_count("text"))).first()[0]
    assert words == got.select(F.sum("taken")).first()[0]


def test_empty(spark):
    assert M.mix(docs_of(spark, [])).count() == 0
    assert M.mixed_documents(docs_of(spark, [])).count() == 0
