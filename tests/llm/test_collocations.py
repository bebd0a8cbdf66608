import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, n long"


def brute(rows, top, least):
    words, counts = Counter(), {}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            f = counts.setdefault(lang, Counter())
            for k in (1, 2, 3):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus(seed, n=150):
    draw = random.Random(seed)
    words = ["the", "The", "of", "New", "York", "city", "a\x01", "été", "日本", "b", "x\x0fy"]
    texts = []
    for _ in range(n):
        w = [draw.choice(["New York city", "of the", draw.choice(words), draw.choice(words)]) for _ in range(draw.randrange(40))]
        texts.append("".join(x + draw.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b"]) for x in w))
    return [(i, t, draw.choice(["en", "en", "fr", None, "", "de"])) for i, t in enumerate([*texts, "", None, " . ", "the of " * 300])]


@pytest.mark.parametrize("seed,top,least", [(1, 2000, 10), (2, 5, 3), (3, 2000, 1)])
def test_equals_brute_force(spark, seed, top, least):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5).withColumn("w1", F.lit("x")).withColumn("c", F.lit(1))
    assert sorted(tuple(r) for r in C.collocations(docs, top, least).collect()) == brute(rows, top, least)


def test_ranges_cut_hot_words_and_small_slices(spark, monkeypatch):
    """One first word in all phrases, spread over many ranges; streams read in many partitions and small batches."""
    monkeypatch.setattr(C, "COUNT_BYTES", 200)
    monkeypatch.setattr(C, "HASH_BYTES", 50)
    monkeypatch.setattr(C, "RANGES_PER_PARTITION", 20)
    draw = random.Random(6)
    rows = [(i, " ".join(f"hot {draw.choice(['pair', 'w'])} {draw.choice('abcdefgh')}{draw.randrange(6)}" for _ in range(60)), "en") for i in range(80)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3)
        assert len(C._splits(docs.select("lang", "text"), 60, 0)) > 20
        assert sorted(tuple(r) for r in C.collocations(docs, 2000, 2).collect()) == brute(rows, 2000, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_two_words_of_one_number(spark, monkeypatch):
    rows = corpus(4)
    find, tried = C.Words.__init__, []

    def clashing(self, texts, langs, seed):
        find(self, texts, langs, seed)
        if seed == 0:
            self.number = self.number % 3 + 1

    monkeypatch.setattr(C.Words, "__init__", clashing)
    count = C._count
    monkeypatch.setattr(C, "_count", lambda splits, seed: tried.append(seed) or count(splits, seed))
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(2)
    assert sorted(tuple(r) for r in C.collocations(docs, 2000, 10).collect()) == brute(rows, 2000, 10)
    assert tried == [0, 1]


def test_cuts():
    draw = np.random.default_rng(2)
    w = C.Words(pa.array([" ".join(map(str, draw.integers(0, 9, 500)))]), pa.array(["en"]), 0)
    numbers, _, _, two, _, three, _ = C._ranks(w)
    pick = np.stack([draw.choice(np.append(numbers, draw.integers(1, 1 << 62, 3)), 40) for _ in range(3)], 1)
    splits = np.unique(pick, axis=0)
    n = numbers.tolist()
    keys = ([(x, 0, 0) for x in n], [(n[c >> 32], n[c & 0xFFFFFFFF], 0) for c in two.tolist()])
    keys = (*keys, [(*keys[1][c >> 32][:2], n[c & 0xFFFFFFFF]) for c in three.tolist()])
    for got, all_ in zip(C._cuts(numbers, two, three, splits), keys, strict=True):
        assert got.tolist() == [sum(k < tuple(s) for k in all_) for s in splits.tolist()]


def test_exact_beyond_64_bits(spark):
    phrases = [(7, 0, 0, 3 * 10**14), (8, 0, 0, 2 * 10**14), (7, 8, 0, 10**14)]
    df = spark.createDataFrame([(*p,) for p in phrases], "w1 long, w2 long, w3 long, c long")
    assert [r["score"] for r in C.scored(df).collect()] == [10**6 * 10**28 // (6 * 10**28)]


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, 0), (2, "", "en", 0)], SCHEMA)).count() == 0
