"""Quality rules: counted text statistics and a hashed n-gram logistic regression.

The model is trained on a bounded sample of the labelled documents, drawn by a hash of their id: at most
SAMPLE_PER_CLASS of each class. Every third of them is held back to calibrate its probabilities. Everything else
reads all documents and whole texts: one map over Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.grams import Texts, combine, mix64, slices
from tickloom.llm.text import SPACE_CHARS, or_empty, table
from tickloom.session import cut_lineage

#: The symbols that n_symbols counts, and the limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SAMPLE_PER_CLASS = 1000
BUCKETS = 1 << 15
KEEP_FROM = 0.5
CHAR_N, WORD_N = 3, 2

_SALTS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, 3, dtype=np.uint64)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


class Model(NamedTuple):
    """Weight per bucket, bias, and slope and offset of the calibration; None stands for a model that keeps all."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def ngram_buckets(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For characters, words and word pairs: the document and the bucket of each n-gram."""
    prefix = t.prefix()
    s, e, doc = t.words()
    word = t.hashes(prefix, s, e)
    chars = np.append(t.characters(), len(t.bytes))
    a, b = chars[:-CHAR_N], chars[CHAR_N:]
    at = t.document_of(a)
    inside = b <= t.offsets[at + 1]
    together = doc[: 1 - WORD_N] == doc[WORD_N - 1 :]
    found = [
        (at[inside], t.hashes(prefix, a[inside], b[inside])),
        (doc, word),
        (doc[: 1 - WORD_N][together], combine(word, WORD_N)[together]),
    ]
    return [(d, (mix64(h ^ salt) % np.uint64(BUCKETS)).astype(np.int64)) for (d, h), salt in zip(found, _SALTS, strict=True)]


def linear_scores(t: Texts, weights: np.ndarray) -> np.ndarray:
    """Per document and kind of n-gram the mean weight of its n-grams, summed over the kinds."""
    total = np.zeros(t.n)
    for doc, bucket in ngram_buckets(t):
        n = np.bincount(doc, minlength=t.n)
        total += np.bincount(doc, weights=weights[bucket], minlength=t.n) / np.maximum(n, 1)
    return total


def statistics(texts: pa.Array, t: Texts) -> dict[str, np.ndarray]:
    s, e, doc = t.words()
    n_words = np.bincount(doc, minlength=t.n)
    space = t.is_space()
    out = {
        "n_words": n_words,
        "word_chars": t.per_document(~space & ((t.bytes & 0xC0) != 0x80)),
        "n_symbols": t.per_document(_SYMBOL[t.bytes]),
    }
    lines = ([x for x in (v or "").split("\n") if x.strip(SPACE_CHARS)] for v in texts.to_pylist())
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    covered = np.zeros(len(s) + 1, np.int64)
    if len(s) >= 3:
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        # equal windows of one document meet when sorted; the document is part of the key
        key = mix64(combine(t.hashes(t.prefix(), s, e), 3)[inside] + mix64(doc[inside].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            covered[inside[again] + k] = 1
    out["n_repeat_words"] = np.bincount(doc, weights=covered[:-1], minlength=t.n).astype(np.int64)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, fold, and the n-gram shares of each document as (bucket, share) arrays."""
    for batch in batches:
        for a, b in slices(batch["text"]):
            part = batch.slice(a, b - a)
            t = Texts(part["text"])
            counts = []
            for doc, bucket in ngram_buckets(t):
                key, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
                total = np.bincount(doc, minlength=t.n)
                counts.append((key, n / np.maximum(total[key // BUCKETS], 1)))
            key = np.concatenate([k for k, _ in counts])
            order = np.argsort(key, kind="stable")
            key, share = key[order], np.concatenate([v for _, v in counts])[order].astype(np.float32)
            cut = np.searchsorted(key // BUCKETS, np.arange(t.n + 1))
            pick = [slice(cut[i], cut[i + 1]) for i in range(t.n)]
            yield pa.RecordBatch.from_arrays(
                [
                    part["good"].cast(pa.int32()),
                    part["fold"].cast(pa.int32()),
                    pa.array([(key[p] % BUCKETS).astype(np.uint16).tobytes() for p in pick], pa.binary()),
                    pa.array([share[p].tobytes() for p in pick], pa.binary()),
                ],
                names=["good", "fold", "buckets", "shares"],
            )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(good: np.ndarray, held: np.ndarray, rows: np.ndarray, bucket: np.ndarray, share: np.ndarray) -> Model:
    """Logistic regression by gradient steps with momentum on the sparse shares, then a Platt fit on the held rows."""
    n = len(good)
    mean = np.bincount(bucket, weights=share, minlength=BUCKETS) / max(n, 1)
    scale = 1 / np.sqrt(mean + 1e-6)  # rare n-grams count as much as common ones
    x = share * scale[bucket]
    train = (~held).astype(float)
    train /= np.where(good == 1, max(1.0, train[good == 1].sum()), max(1.0, train[good == 0].sum())) * 2
    norm = np.bincount(rows, weights=x * x, minlength=n)
    step = 4.0 / max(1e-9, float((train * norm).sum()))
    w, bias, pace, pace_b = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    for _ in range(150):
        z = np.bincount(rows, weights=x * w[bucket], minlength=n) + bias
        g = train * (_sigmoid(z) - good)
        pace = 0.9 * pace - step * (np.bincount(bucket, weights=x * g[rows], minlength=BUCKETS) + 1e-4 * w)
        pace_b = 0.9 * pace_b - step * g.sum()
        w, bias = w + pace, bias + pace_b
    z = np.bincount(rows, weights=x * w[bucket], minlength=n) + bias
    slope, offset = calibrate(z[held], good[held])
    return Model((w * scale).astype(np.float32), float(bias), slope, offset)


def calibrate(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid through held-out scores, with Platt's softened targets."""
    pos, neg = (good == 1).sum(), (good == 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(good == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        v = p * (1 - p) + 1e-9
        ga, gb = ((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()
        haa, hab, hbb = (v * z * z).sum() + 1e-3, (v * z).sum(), v.sum()
        det = haa * hbb - hab * hab + 1e-9
        a, b = a - np.clip((hbb * ga - hab * gb) / det, -1, 1), b - np.clip((haa * gb - hab * ga) / det, -1, 1)
    return float(max(a, 1e-3)), float(b)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    good = np.concatenate([np.asarray(b["good"]) for b in parts] or [np.empty(0, int)])
    held = np.concatenate([np.asarray(b["fold"]) for b in parts] or [np.empty(0, int)]) == 0
    bucket = [np.frombuffer(v, np.uint16) for b in parts for v in b["buckets"].to_pylist()]
    share = [np.frombuffer(v, np.float32) for b in parts for v in b["shares"].to_pylist()]
    if any((good[~held] == c).sum() == 0 for c in (0, 1)):
        return
    rows = np.repeat(np.arange(len(bucket)), [len(x) for x in bucket])
    m = fit(good.astype(float), held, rows, np.concatenate(bucket).astype(np.int64), np.concatenate(share).astype(float))
    yield pa.RecordBatch.from_arrays(
        [pa.array([m.weights.tobytes()], pa.binary()), *(pa.array([v]) for v in (m.bias, m.slope, m.offset))],
        names=["weights", "bias", "slope", "offset"],
    )


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """The model, or None where the labels do not have both classes. A document with several labels takes the lowest."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
    draw = lambda c: known.where(F.col("good") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = F.broadcast(draw(0).unionByName(draw(1)))  # at most 2 * per_class rows
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).alias("fold")
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("good", fold, or_empty("text").alias("text"))
    # written first: all tasks read the texts, and only the bounded features meet in one
    features = cut_lineage(texts.mapInArrow(_features, "good int, fold int, buckets binary, shares binary"))
    found = features.coalesce(1).mapInArrow(_train, "weights binary, bias double, slope double, offset double").take(1)
    if not found:
        return None
    m = found[0]
    return Model(np.frombuffer(bytes(m["weights"]), np.float32), m["bias"], m["slope"], m["offset"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdicts(texts: pa.Array, model: Model | None, keep_from: float = KEEP_FROM) -> dict[str, np.ndarray]:
    """The counts, base_failed, probability of good quality, and kept, for one slice of texts."""
    t = Texts(texts)
    out = statistics(texts, t)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    if model is None:
        out["quality"] = np.ones(t.n)
    else:
        out["quality"] = _sigmoid(model.slope * (linear_scores(t, model.weights) + model.bias) + model.offset)
    out["kept"] = ~out["base_failed"] & (out["quality"] >= keep_from)
    return out


def judge(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, the five counts, base_failed, quality, kept: one row per input row.

    A null text has no words and fails the base rules. Rows that repeat an id are judged one by one. With labels of
    one class only, or none, only the base rules reject. An empty table gives an empty result; other columns are
    ignored.
    """
    model = train(docs, labels, per_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                out = verdicts(part["text"], model)
                columns = [part["doc_id"], *(pa.array(out[c].astype(np.int64)) for c in COUNTS)]
                columns += [pa.array(out["base_failed"]), pa.array(out["quality"]), pa.array(out["kept"])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "quality", "kept"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"doc_id long, {counts}, base_failed boolean, quality double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, schema)


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model, at = train(docs, labels, per_class), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(verdicts(part.column(at), model)["kept"]))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
