import random

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import docs_of
from tickloom.llm import pieces as P

VOCABULARY = P.load()
ENCODER = P.Encoder(VOCABULARY)
PROCESSOR = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def encoded(texts):
    ids, at = ENCODER.texts(texts)
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


def check(texts):
    got = encoded(texts)
    assert got == PROCESSOR.encode([t or "" for t in texts], num_threads=1)
    for t, ids in zip(texts, got, strict=True):
        assert P.decode(np.array(ids, np.int64), VOCABULARY) == (t or "").replace("▁", " ")


def test_awkward_texts():
    check(["", None, " ", "   x  y ", "\n\n a\n", "▁▁x ▁", "中文 \U0001f600 é①ﬁ", "\x00\x01", "a" * 3000, " " * 500 + "b", "Don't stop-me now... 1234567890\t"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text_equals_the_library(texts):
    check(texts)


def test_prose_over_many_index_batches(monkeypatch):
    monkeypatch.setattr(P, "INDEX_BYTES", 200)
    draw = random.Random(3)
    words = "the of retion enthing über straße niño élève 2024 http://x.org/a?b=c foo_bar".split()
    check([" ".join(draw.choice(words) + draw.choice(["", ",", "s", "\n"]) for _ in range(80)) for _ in range(20)])


def test_occurrences_equal_brute_force():
    data = np.frombuffer(b" the theory\n then a nation\n", np.uint8)
    at, piece = ENCODER.edges(data, np.arange(len(data)))
    raw = data.tobytes()
    want = {(i, n) for n, p in enumerate(VOCABULARY.text) for i in range(len(raw)) if raw.startswith(p, i)}
    assert set(zip(at.tolist(), piece.tolist(), strict=True)) == want


def test_table(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (1, "one two"), (None, "x" * 50000)]
    got = P.encode(docs_of(spark, rows))
    assert got.count() == 5 and got.where("NOT round_trip").count() == 0
    texts = {r["doc_id"]: r["text"] for r in P.decoded(got).collect()}
    assert texts == {1: "one two", 2: "", 3: "", None: "x" * 50000}
    assert P.encode(docs_of(spark, [])).count() == 0
