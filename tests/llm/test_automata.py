import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of
from tickloom.llm import automata as A


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def corpus(seed, n=80):
    draw = random.Random(seed)
    words = ["a", "b", "é", "the", "of", "x\x01"]
    passages = [[draw.choice(words) for _ in range(draw.randrange(3, 40))] for _ in range(8)] + [["r"] * 30]
    fresh = lambda: [f"{draw.choice(words)}{draw.randrange(50)}" for _ in range(draw.randrange(12))]
    texts = []
    for _ in range(n):
        w = [x for _ in range(draw.randrange(4)) for x in draw.choice(passages)[draw.randrange(3) :] + fresh()]
        texts.append("".join(x + draw.choice([" ", "\n", "\t ", "  "]) for x in w))
    return texts + ["", None, " \n", texts[3], texts[3], "z " * 9, "q " * 400]


@pytest.mark.parametrize("seed,window,gram,hot", [(1, 8, 3, 2000), (2, 12, 4, 2000), (3, 8, 3, 1), (4, 12, 4, 3), (5, 35, 8, 1), (6, 5, 5, 2)])
def test_equals_brute_force(spark, seed, window, gram, hot):
    texts = corpus(seed)
    docs = docs_of(spark, list(enumerate(texts))).repartition(5).withColumn("key", F.lit(0)).withColumn("words", F.lit("x"))
    got = {r["doc_id"]: tuple(r)[1:] for r in A.without_passages(docs, window, gram, hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_automaton_alone():
    draw = random.Random(9)
    segments = list({tuple(draw.choice("ab") for _ in range(draw.randrange(1, 14))) for _ in range(30)})
    times = [draw.randrange(1, 3) for _ in segments]
    found = A.Automaton([list(s) for s in segments], times)
    stands = lambda x: sum(n * sum(s[i : i + len(x)] == x for i in range(len(s) - len(x) + 1)) for s, n in zip(segments, times, strict=True))
    for s in [*segments, tuple("abbabab"), tuple("cab"), ()]:
        want = [max((m for m in range(e + 1) if m == 0 or stands(s[e - m : e]) > 1), default=0) for e in range(1, len(s) + 1)]
        assert list(found.statistics(list(s))) == want


def test_shards_of_a_few_words(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_WORDS", 10)
    monkeypatch.setattr(A, "SLICE", 100)
    texts = corpus(11)
    got = {r["doc_id"]: tuple(r)[1:] for r in A.without_passages(docs_of(spark, list(enumerate(texts))), 8, 3).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 8)


def test_null_and_repeated_ids_and_empty(spark):
    text = " ".join(map(str, range(40)))
    rows = [(2, "new " + text), (1, text), (1, text), (None, text), (3, None), (4, "short text"), (5, "short text")]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"]) for r in A.without_passages(docs_of(spark, rows)).collect())
    assert got == [(False, 1, 40, 40), (False, 1, 40, 40), (False, 2, 41, 40), (False, 3, 0, 0), (False, 4, 2, 0), (False, 5, 2, 0), (True, None, 40, 40)]
    assert A.without_passages(docs_of(spark, [])).count() == 0


def test_very_long(spark):
    draw = random.Random(4)
    words = [str(draw.randrange(10**6)) for _ in range(150_000)]
    got = {r["doc_id"]: r["n_removed"] for r in A.without_passages(docs_of(spark, [(1, " ".join(words)), (2, " ".join(words[70_000:70_050]))])).collect()}
    assert got == {1: 50, 2: 50}
