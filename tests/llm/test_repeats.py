import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of
from tickloom.llm import repeats as R


def brute(texts, length):
    """texts in order of documents."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, bool)
        for j in range(len(raw) - length + 1):
            w = raw[j : j + length]
            if w in seen:
                cover[j : j + length] = True
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover, strict=False) if not c)
        spans = int((cover[1:] & ~cover[:-1]).sum() + cover[0])
        out.append((len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    draw = random.Random(seed)
    parts = ["".join(draw.choice("abcé ") for _ in range(draw.randrange(5, 60))) for _ in range(12)] + ["a" * 90, "ab" * 50]
    texts = ["".join(draw.choice(parts)[draw.randrange(4) :] for _ in range(draw.randrange(6))) for _ in range(n)]
    return texts + ["", None, texts[3], "z" * 15, "z" * 300]


@pytest.mark.parametrize("seed,length,k", [(1, 12, 4), (2, 20, 5), (3, 7, 7), (4, 100, 16)])
def test_equals_brute_force(spark, seed, length, k):
    texts = corpus(seed)
    docs = docs_of(spark, list(enumerate(texts))).repartition(5).withColumn("runs", F.lit(0))
    got = {r["doc_id"]: tuple(r)[1:] for r in R.without_repeats(docs, length, k).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_columns_alone():
    draw = random.Random(7)
    strings, anchor = [], []
    for _ in range(80):
        s = "".join(draw.choice("ab") for _ in range(draw.randrange(6, 15)))
        strings.append(s.encode())
        anchor.append(draw.randrange(0, len(s) - 5))
    group = np.array([draw.randrange(3) for _ in strings])
    age = np.array(draw.sample(range(80), 80))
    got = set(zip(*(v.tolist() for v in R.repeats_by_columns(strings, np.array(anchor), group, age, 6)), strict=True))
    at = lambda i, x: strings[i][x + anchor[i] : x + anchor[i] + 6] if 0 <= x + anchor[i] <= len(strings[i]) - 6 else None
    want = {(i, x) for i in range(80) for x in range(-15, 15) if (w := at(i, x)) and any(group[j] == group[i] and age[j] < age[i] and at(j, x) == w for j in range(80))}
    assert got == want and want


def test_repeated_and_null_ids(spark):
    rows = [(2, "x" * 5 + "repeated passage of text"), (1, "repeated passage of text"), (1, "repeated passage of text"), (None, "repeated passage of text"), (3, None)]
    got = sorted(R.without_repeats(docs_of(spark, rows), 12, 4).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_removed"]))
    assert [(r["doc_id"], r["n_removed"]) for r in got] == [(1, 0), (1, 24), (2, 24), (3, 0), (None, 24)]


def test_empty(spark):
    assert R.without_repeats(docs_of(spark, [])).count() == 0
    assert R.without_repeats(docs_of(spark, [(1, None), (2, "")])).count() == 2
