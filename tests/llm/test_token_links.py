import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import docs_of
from tickloom.llm import token_links as T


def brute(texts):
    """Rows in order of the texts, by the two libraries and plain loops."""
    a_tok = Tokenizer.from_file(T.BYTE_BPE)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=T.PIECE_BPE)
    letters = T._byte_letters()
    out_a = lambda i: bytes(letters[c] for c in a_tok.id_to_token(i))
    out_b = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for t in texts:
        links, groups, n_a, n_b = [], [], 0, 0
        if t:
            ids, raw = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)), (" " + t).encode()
            outs = [[f(i) for i in v] for f, v in zip((out_a, out_b), ids, strict=True)]
            if all(b"".join(o) == raw for o in outs):
                n_a, n_b = map(len, ids)
                ends = [dict(zip(np.cumsum([len(x) for x in o]).tolist(), v, strict=True)) for o, v in zip(outs, ids, strict=True)]
                before = 0
                for e in sorted(ends[0].keys() & ends[1].keys()):
                    links.append((ends[0][e], ends[1][e]))
                    groups.append("|".join(",".join(str(d[x]) for x in sorted(d) if before < x <= e) for d in ends))
                    before = e
        counts.update(links)
        found.append((n_a, n_b, links, ";".join(groups)))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (n_a, n_b, len(v), len(v), sum(counts[x] == most[x[1]] for x in v), sum(counts[x] for x in v), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for n_a, n_b, v, g in found
    ], counts


TEXTS = [
    None, "", "x", " ", "  two  spaces ", "\n\n", "the cat sat on the mat", "the cat sat on the mat", "été où naïve ça 日本語 🙂 مرحبا",
    "<|endoftext|> </s><s> <unk>", "under▁score", "a\x00b\tc\r\n", "3.14159 and 2,718", "don't we'll I'm", "word " * 500, "ab" * 3000,
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(docs, texts, key="doc_id"):
    got = {r[key]: tuple(r[c] for c in COLUMNS) for r in T.token_links(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)[0]


def test_equals_brute_force(spark):
    draw = random.Random(5)
    words = ["tokeniser", "naïve", "the", "of", "12", "x.y", "—", "\n", "Straße", "的"]
    texts = TEXTS + [" ".join(draw.choice(words) for _ in range(draw.randrange(30))) for _ in range(60)]
    check(docs_of(spark, list(enumerate(texts))).repartition(5).withColumn("row", F.lit("x")).withColumn("bits", F.lit(1)), texts)


def test_many_postings_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_POSTINGS", 50)
    monkeypatch.setattr(T, "SLICE", 100)
    monkeypatch.setattr(T, "SPARSE", 8)  # bitmaps
    texts = [t for t in TEXTS if t is None or len(t) < 100] * 6
    check(docs_of(spark, list(enumerate(texts))).coalesce(2), texts)


def test_pairs(spark):
    texts = TEXTS[:13]
    found = T.Alignment(docs_of(spark, list(enumerate(texts))).repartition(3))
    counts = brute(texts)[1]
    got = {(r["a"], r["b"]): (r["n_links"], r["best"]) for r in found.pairs.collect()}
    assert {k: v[0] for k, v in got.items()} == dict(counts)
    assert all(best == (n == max(m for (_, y), m in counts.items() if y == b)) for (_, b), (n, best) in got.items())
    docs = {(r["a"], r["b"]): r["n_docs"] for r in found.pairs.collect()}
    held = Counter(x for t in texts for x in set(brute([t])[1]))
    assert docs == dict(held)


def test_sets():
    draw = np.random.default_rng(3)
    for n in (0, 1, 4095, 4096, 65536):
        rows = np.sort(draw.choice(T.BLOCK, n, replace=False))
        other = np.sort(draw.choice(T.BLOCK, 5000, replace=False))
        assert T.unpacked(T.packed(rows)).tolist() == rows.tolist() and T.count(T.packed(rows)) == n
        assert T.unpacked(T.united([T.packed(rows), T.packed(other)])).tolist() == np.union1d(rows, other).tolist()


def test_null_and_repeated_ids_and_empty(spark):
    got = sorted(T.token_links(docs_of(spark, [(None, "a b"), (1, "a b"), (1, "c"), (2, None)])).collect(), key=repr)
    assert len(got) == 4 and sorted(r["n_a"] for r in got) == [0, 1, 2, 2] and {r["count_sum"] for r in got if r["n_a"] == 2} == {4}
    assert T.token_links(docs_of(spark, [])).count() == 0
    assert T.token_links(docs_of(spark, [(1, None)])).collect()[0]["groups_sha256"] == ""


@pytest.mark.parametrize("text", [" " * 1_100_000 + "x", "\n" * 30_000, "z" * 1_000_000])
def test_very_long(spark, text):
    row = T.token_links(docs_of(spark, [(1, text)])).collect()[0]
    assert row["n_a"] > 0 and row["n_links"] > 0 and row["count_sum"] >= row["n_links"]
