"""Removal of repeated byte strings by column-wise construction over collections of text segments.

A string of LENGTH bytes that stands twice is found where it stands second, and its bytes are removed.

1. *Candidates.* In every window of LENGTH bytes the least hashed K-gram is its anchor. Equal windows have equal
   anchors at equal offsets, so windows whose anchor is nowhere else are settled. Neighbouring windows with one anchor
   form a run; the runs' anchors are dealt to buckets, counted, and those found once are dropped. What travels of a
   run is its anchor's hash and its number in the document; runs are found again where the text is at hand.
2. *Segments.* The text of each run that is left (its windows, LENGTH - 1 bytes longer) goes to the task of its
   anchor. Equal segments are one string with several places, before the shuffle and after it.
3. *Columns.* The strings of an anchor are aligned at it and read from the last column to the first. Each round inserts
   one symbol per string: the order of the strings is stably sorted by it, which keeps them sorted by all that is read,
   the column of symbols in that order being the collection's (positional) Burrows-Wheeler transform; and the common
   prefix of neighbours becomes one more than the least one between them before the round. Neighbours with a common
   prefix of LENGTH start with equal windows in this column: all but the earliest are repeats. What a round finds is
   appended to a file, which is read once in sequence when the columns are done.
4. *Removal.* The repeats' bytes are collected per document and cut out.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.grams import Texts, mix64, slices
from tickloom.llm.text import or_empty, table
from tickloom.session import cut_lineage

LENGTH, K = 100, 24
DEAL_BYTES = 1 << 20
#: Strings whose columns are built together; all strings of an anchor are.
COLLECTION = 20_000

_U = np.uint64
_RUN = np.dtype([("key", "<i8"), ("start", "<i8"), ("n", "<i4"), ("anchor", "<i4")])


def runs_of(t: Texts, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and (key, start, n, anchor) of every run of windows with one anchor; anchor counts from start."""
    total, w = len(t.bytes), length - k + 1
    if total < length:
        return np.empty(0, np.int64), np.empty(0, _RUN)
    prefix = t.prefix()
    at = np.arange(total - k + 1)
    hashes = t.hashes(prefix, at, at + k)
    bits = _U(max(28, int(total).bit_length()))  # the same for a document however texts are sliced
    packed = ((hashes >> bits) << bits) | at.astype(np.uint64)
    least, size = packed, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: size - w], least[w - size :])
    doc_end = np.repeat(t.offsets[1:], np.diff(t.offsets))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + length <= doc_end)
    if not len(window):
        return np.empty(0, np.int64), np.empty(0, _RUN)
    place = (least[window] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    first = np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])
    begin = np.flatnonzero(first)
    doc = t.document_of(window[begin])
    out = np.empty(len(begin), _RUN)
    out["key"] = hashes[place[begin]].view(np.int64)
    out["start"] = window[begin] - t.offsets[doc]
    out["n"] = np.diff(np.append(begin, len(window)))
    out["anchor"] = place[begin] - window[begin]
    return doc, out


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of runs of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return begin, np.append(begin[1:], len(key))[: len(begin)]


def _deal(buckets: int, length: int, k: int):
    """Anchors dealt to buckets: per document and bucket their hashes (6 bytes each) and the numbers of their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], DEAL_BYTES):
                part = batch.slice(a, b - a)
                t = Texts(part["text"])
                doc, runs = runs_of(t, length, k)
                number = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype("<u4")
                key = mix64(np.ascontiguousarray(runs["key"]).view(np.uint64))
                bucket, key = (key % _U(buckets)).astype(np.int32), (key // _U(buckets)).astype("<u8")
                order = np.argsort(bucket, kind="stable")
                bucket, doc, number = bucket[order], doc[order], number[order]
                six = np.ascontiguousarray(key[order].view(np.uint8).reshape(-1, 8)[:, :6])
                held = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])])[: len(doc)])
                ids, counts = np.asarray(part["doc_id"])[doc[held]], np.diff(np.append(held, len(doc))).astype("<u4")
                begin, end = _grouped(bucket)
                lo, hi = np.searchsorted(held, begin), np.searchsorted(held, end)
                cut = lambda v, x, y: pa.array([v[i:j].tobytes() for i, j in zip(x, y, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begin]), cut(ids, lo, hi), cut(counts, lo, hi), cut(six, begin, end), cut(number, begin, end)],
                    names=["bucket", "ids", "counts", "keys", "numbers"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the numbers of the runs whose anchor is found more than once."""
    names = ("ids", "counts", "keys", "numbers")
    held: dict[int, list[tuple[bytes, ...]]] = {}
    for batch in batches:
        for bucket, *row in zip(*(batch[c].to_pylist() for c in ("bucket", *names)), strict=True):
            held.setdefault(bucket, []).append(tuple(row))
    for bucket in list(held):
        ids, counts, six, number = (b"".join(v) for v in zip(*held.pop(bucket), strict=True))
        ids = np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, "<u4"))
        number = np.frombuffer(number, "<u4")
        key = np.zeros((len(number), 8), np.uint8)
        key[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
        key = key.view("<u8").ravel()
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = order[(np.concatenate([same, [False]]) | np.concatenate([[False], same]))[: len(order)]]
        again = again[np.argsort(ids[again], kind="stable")]
        ids, number = ids[again], number[again]
        begin, end = _grouped(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[begin]), pa.array([number[i:j].tobytes() for i, j in zip(begin, end, strict=True)], pa.binary())],
            names=["doc_id", "numbers"],
        )


def _segments(length: int, k: int):
    """The text of the candidate runs; equal segments of a batch are one row with several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], DEAL_BYTES):
                part = batch.slice(a, b - a)
                t = Texts(part["text"])
                doc, runs = runs_of(t, length, k)
                first, raw = np.searchsorted(doc, np.arange(t.n)), t.bytes.tobytes()
                found: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
                for i, (doc_id, lists) in enumerate(zip(part["doc_id"].to_pylist(), part["numbers"].to_pylist(), strict=True)):
                    at = int(t.offsets[i])
                    for key, start, n, anchor in runs[first[i] + np.frombuffer(b"".join(lists), "<u4")].tolist():
                        segment = raw[at + start : at + start + n + length - 1]
                        found.setdefault((key, anchor, segment), []).append((doc_id, start))
                places = [np.array(v, np.int64) for v in found.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([x[1] for x in found], pa.int32()),
                        pa.array([x[2] for x in found], pa.binary()),
                        pa.array([v.tobytes() for v in places], pa.binary()),
                    ],
                    names=["key", "anchor", "bytes", "places"],
                )

    return run


def repeats_by_columns(
    strings: list[bytes], anchor: np.ndarray, group: np.ndarray, age: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(string, column) of every window that an older string of its group has in the same column.

    Columns count from the anchor, which is `anchor` symbols after the beginning of its string.
    """
    size = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum(size) - size + anchor
    order = np.argsort(group, kind="stable")
    common = np.zeros(len(order) + 1, np.int32)  # with the neighbour before, in this order
    with tempfile.TemporaryFile() as found:
        for x in range(int((size - anchor).max()) - 1, -int(anchor.max()) - 1, -1):
            held = np.flatnonzero(x >= -anchor[order])
            now = order[held]
            begun = x < (size - anchor)[now]
            symbol = np.where(begun, data[np.where(begun, base[now] + x, 0)], -1).astype(np.int64)
            key = group[now] * 257 + symbol + 1
            turn = np.argsort(key, kind="stable")
            old, key, begun = held[turn], key[turn], begun[turn]
            order = now[turn]
            pair = np.flatnonzero((key[1:] == key[:-1]) & begun[1:])
            after = np.zeros(len(order) + 1, np.int32)
            if len(pair):
                between = np.empty(2 * len(pair), np.int64)
                between[0::2], between[1::2] = old[pair] + 1, old[pair + 1] + 1
                after[pair + 1] = np.minimum(np.minimum.reduceat(common, between)[0::2] + 1, length)
            common = after
            whole = common[: len(order)] >= length
            if whole.any():
                begin = np.flatnonzero(~whole)
                oldest = np.repeat(np.minimum.reduceat(age[order], begin), np.diff(np.append(begin, len(order))))
                late = order[age[order] != oldest]
                np.stack([late, np.full(len(late), x)], 1).astype("<i4").tofile(found)
        found.seek(0)
        pairs = np.fromfile(found, "<i4").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1]


def _spans(keys: list[int], anchors: list[int], strings: list[bytes], places: list[np.ndarray], length: int):
    """Byte ranges (doc_id, begin, end) to remove: whole repeats of a string, and what the columns find in it."""
    first = [p[np.lexsort((p[:, 1], p[:, 0]))[0]] for p in places]
    for s, p, f in zip(strings, places, first, strict=True):
        later = p[(p[:, 0] != f[0]) | (p[:, 1] != f[1])]
        if len(later):
            yield later[:, 0], later[:, 1], later[:, 1] + len(s)
    group = np.unique(np.array(keys), return_inverse=True)[1]
    many = np.bincount(group)[group] > 1
    chosen = np.flatnonzero(many)
    chosen = chosen[np.argsort(group[chosen], kind="stable")]
    a = 0
    while a < len(chosen):
        b = min(len(chosen), a + COLLECTION)
        while b < len(chosen) and group[chosen[b]] == group[chosen[b - 1]]:
            b += 1
        part = chosen[a:b]
        anchor = np.array([anchors[i] for i in part])
        place = np.array([first[i] for i in part])
        age = np.empty(len(part), np.int64)
        age[np.lexsort((place[:, 1] + anchor, place[:, 0]))] = np.arange(len(part))
        string, column = repeats_by_columns([strings[i] for i in part], anchor, group[part], age, length)
        order = np.lexsort((column, string))
        string, column = string[order], column[order]
        if len(string):
            begin = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (column[1:] != column[:-1] + 1)]))
            end = np.append(begin[1:], len(string)) - 1
            at = place[string[begin], 1] + anchor[string[begin]]
            yield place[string[begin], 0], at + column[begin], at + column[end] + length
        a = b


def _by_columns(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, bytes], list[bytes]] = {}
        for batch in batches:
            for key, anchor, raw, places in zip(*(batch[c].to_pylist() for c in ("key", "anchor", "bytes", "places")), strict=True):
                held.setdefault((key, anchor, raw), []).append(places)
        if not held:
            return
        keys, anchors, strings = ([k[i] for k in held] for i in range(3))
        places = [np.frombuffer(b"".join(v), np.int64).reshape(-1, 2) for v in held.values()]
        for doc_id, begin, end in _spans(keys, anchors, strings, places, length):
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (doc_id, begin, end)], names=["doc_id", "begin", "end"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, begin, end): byte ranges, overlapping and possibly several times, that an earlier string repeats.

    doc_id must be unique and not null; text must not be null.
    """
    parts = max(1, docs.rdd.getNumPartitions())
    dealt = docs.mapInArrow(_deal(parts, length, k), "bucket int, ids binary, counts binary, keys binary, numbers binary")
    candidates = cut_lineage(dealt.repartition(parts, "bucket").mapInArrow(_repeated, "doc_id long, numbers binary"))
    lists = candidates.groupBy("doc_id").agg(F.collect_list("numbers").alias("numbers"))
    texts = docs.join(lists, "doc_id").select("doc_id", "text", "numbers")
    segments = texts.mapInArrow(_segments(length, k), "key long, anchor int, bytes binary, places binary")
    return segments.repartition(4 * parts, "key").mapInArrow(_by_columns(length), "doc_id long, begin long, end long")


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch["text"], DEAL_BYTES):
            rows = []
            for text, begins, ends in zip(*(batch.slice(a, b - a)[c].to_pylist() for c in ("text", "begins", "ends")), strict=True):
                raw, spans = text.encode(), unite(list(zip(begins or [], ends or [], strict=True)))
                rows.append((len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(cut(raw, spans)).hexdigest()))
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_unique_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with unique ids that are not null, and the table that leads back to the given ids if they differ.

    Only rows with a null or repeated id are renumbered tables: they are written once in order of id (null last) and
    text, and numbered as they are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty("text").cast("string").alias("text"))
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL").isEmpty():
        # said again, so that both joins on the texts read one exchange of them
        return rows.where("doc_id IS NOT NULL"), None
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("_row", F.monotonically_increasing_id())
    numbered = cut_lineage(ordered)
    return numbered.select(F.col("_row").alias("doc_id"), "text").where("doc_id IS NOT NULL"), numbered.select("_row", F.col("doc_id").alias("_given"))


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row.

    A null text is empty. Rows with null ids come after all others. Rows that repeat an id are documents of their own,
    in order of their texts, so of equal rows the first keeps its text. Texts shorter than the length lose nothing.
    An empty table gives an empty result; other columns are ignored.
    """
    rows, given = with_unique_ids(docs)
    spans = repeated_spans(rows, length, k).groupBy("doc_id").agg(
        F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends")
    )
    told = rows.join(spans, "doc_id", "left").select("doc_id", "text", "begins", "ends")
    out = told.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if given is None:
        return out
    return out.join(given, out["doc_id"] == given["_row"]).select(F.col("_given").alias("doc_id"), *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
