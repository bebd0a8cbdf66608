import collections
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of
from tickloom.llm import quality as Q
from tickloom.llm.grams import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n\t \x1c", max_size=60)), max_size=8))
def test_counts_equal_brute_force(texts):
    column = pa.array(texts, pa.string())
    got = Q.statistics(column, Texts(column))
    assert [tuple(int(got[c][i]) for c in Q.COUNTS) for i in range(len(texts))] == [brute(t) for t in texts]


def test_scores_are_the_same_however_texts_are_sliced():
    texts = ["one two three four", "", None, "ünï çødé " * 30, "x"]
    w = np.random.default_rng(1).normal(size=Q.BUCKETS)
    whole = Q.linear_scores(Texts(pa.array(texts, pa.string())), w)
    each = [Q.linear_scores(Texts(pa.array([t], pa.string())), w)[0] for t in texts]
    assert np.allclose(whole, each)


def corpus(n):
    draw = random.Random(4)
    good = "the of retion anthing wherely thonder stand inble and from".split()
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [draw.choice(good) + draw.choice(["", "s", "ed", "ing", "ly"]) + str(draw.randrange(40)) for _ in range(80)]
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy_and_rejections(spark):
    rows, labels = corpus(600)
    docs = docs_of(spark, rows + [(600, None), (601, ""), (602, "a b c " * 400), (0, "short"), (None, rows[1][1])])
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1, 0), (3, None, None)], LABELS)
    got = {r["doc_id"]: r for r in Q.judge(docs.withColumn("kept", F.lit(1)), known).collect() if r["n_words"] == 80}
    right = [(got[i]["quality"] >= 0.5) == (i % 5 != 0) for i in range(2, 600, 2)]
    assert sum(right) / len(right) > 0.97
    kept = Q.keep_good(docs.withColumn("n_words", F.lit("extra")), known)
    assert kept.columns[-1] == "n_words"
    ids = [r["doc_id"] for r in kept.collect()]
    assert None in ids and 602 not in ids and 600 not in ids and 5 not in ids and 6 in ids


def test_labels_of_one_class_or_none_keep_what_the_rules_keep(spark):
    rows, labels = corpus(20)
    docs = docs_of(spark, rows)
    for known in ([], [x for x in labels if x[1] == 1]):
        assert Q.judge(docs, spark.createDataFrame(known, LABELS)).where("kept").count() == 20
    assert Q.judge(docs_of(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_held_out_accuracy_on_the_labelled_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = Q.judge(docs, labels.where("doc_id % 2 = 0")).withColumnRenamed("quality", "p")
    r = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").select(
        F.avg(((F.col("p") >= 0.5) == (F.col("quality") == 1)).cast("int")), F.count("*")
    ).first()
    assert r[1] > 1000 and r[0] > 0.98
