import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of
from tickloom.llm import components as C
from tickloom.llm import ngram_join as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(400)}"
    passage = [word() for _ in range(60)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(draw.choice([5, 6, 9, 30, 120, 200]))] + (passage if g % 3 == 0 else [])
        for _ in range(draw.choice([1, 2, 6, 40])):
            t = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, len(t) // 40, len(t) // 25])):
                t[draw.randrange(len(t))] = word()
            rows.append(" ".join(t).replace("w1", draw.choice(["w1", "W1"])))
    rows += [None, "", " \n", "one", "ONE", "one two", "a b c d", "a b c d e", "x " * 300, "x " * 301]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,frequent,tile", [(1, 64, 1024), (2, 2, 1024), (3, 3, 3), (4, 1, 5)])
def test_components_equal_brute_force(spark, monkeypatch, seed, frequent, tile):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "TILE", tile)
    rows = corpus(seed)
    docs = docs_of(spark, rows).withColumn("key", F.lit(3)).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in J.near_duplicates(docs, buckets=3).collect())
    assert got == brute(rows)


def test_similar_sets_share_an_index_entry(monkeypatch):
    """Random pairs of sets at the limit of similarity, with every mix of rare and frequent tokens."""
    monkeypatch.setattr(J, "FREQUENT", 5)
    draw = random.Random(9)
    for _ in range(400):
        n = draw.randrange(4, 90)
        common = draw.sample(range(1000), n)
        extra = draw.randrange(0, n // 4 + 1)
        split = draw.randrange(extra + 1)
        x, y = common + list(range(2000, 2000 + split)), common + list(range(3000, 3000 + extra - split))
        if 100 * n < 80 * (n + extra):
            continue
        df = {t: draw.choice([2, 3, 6, 9, 50]) for t in common}
        entries = []
        for s in (x, y):
            known = sorted((df[t], t * 7919) for t in s if t in df)
            entries.append(J.index_entries(len(s), np.array([f for f, _ in known]), np.array([t for _, t in known], np.int64)))
        assert entries[0] & entries[1]


def test_repeats_nulls_and_the_pipeline_form(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(4, text), (2, text + " end"), (2, "other text of five words"), (None, text), (9, None), (7, "long " * 100_000)]
    docs = docs_of(spark, rows).withColumn("component_id", F.lit("clash"))
    got = sorted((tuple(r) for r in J.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(4, 36, 2), (2, 37, 2), (2, 1, 2), (None, 36, 2), (9, 0, 9), (7, 1, 7)], key=repr)
    kept = J.keep_one_of_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 2, 7, 9]
    assert J.near_duplicates(docs_of(spark, [])).count() == 0


def test_connected_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in C.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: label[v] for v in linked}
    assert C.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_ids_stay_or_go_by_their_own_texts(spark):
    text, clean, pair = (" ".join(f"{c}{i}" for i in range(40)) for c in "tcp")
    rows = [(1, text), (5, text + " end"), (5, clean), (6, pair), (6, pair + " end"), (7, "x y"), (7, "x y")]
    kept = sorted((r["doc_id"], r["text"]) for r in J.keep_one_of_group(docs_of(spark, rows)).collect())
    assert [(i, t.removesuffix(" end")) for i, t in kept] == [(1, text), (5, clean), (6, pair), (7, "x y")]


def test_columns_of_any_name_come_through(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = docs_of(spark, [(1, text), (2, text + " end"), (3, "other")])
    docs = docs.withColumns({"_row": F.lit("x"), "ROW": F.lit("y"), "given": F.lit("z"), "keep": F.lit(1), "id": F.lit(2), "a.b": F.lit("dot")})
    kept = J.keep_one_of_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["_row"], r["ROW"], r["given"], r["a.b"]) for r in kept.collect()) == [(1, "x", "y", "z", "dot"), (3, "x", "y", "z", "dot")]
