"""Removal of passages that stand more than once, by suffix automata of reference shards.

A window is WINDOW consecutive words of a document; every word of a window that stands anywhere else too is removed.

1. *Anchors.* The least hashed GRAM-word phrase of a window is its anchor. Equal windows have equal anchors at equal
   offsets, so windows whose anchor is nowhere else are settled. Neighbouring windows with one anchor form a run.
2. *Reference.* The words of a run whose anchor stands more than once are a segment. Equal segments of a slice of texts
   are one row with several places. All segments of an anchor belong to one shard.
3. *Automata.* A task builds the suffix automaton of its shard's distinct segments, with how often each state's strings
   stand, and streams the segments through it: the matching statistic of a word is the longest string ending there that
   stands twice. Statistics of WINDOW words or more are spans to remove, extended to the left as far as they reach.
   A shard's automaton goes only where segments with its anchors are, instead of to all documents: the reference is the
   corpus itself, so sending every shard to every document would cost the square of it.
4. *Hot anchors.* An anchor of more than HOT distinct segments stands at the edge of a passage that very many documents
   share. Its segments are split into windows, windows that stand once are dropped by a count of their hashes, and
   each window that is left is a segment and an anchor of its own, so no shard grows with the number of documents.
5. *Removal.* Spans go back to all places of their segments and are cut out of the documents.

Segments and windows are told apart by 128 bits of a hash of their words; automata compare the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.grams import Texts, combine, mix64, slices
from tickloom.llm.repeats import unite, with_unique_ids
from tickloom.llm.text import table
from tickloom.session import cut_lineage, ship_package

WINDOW, GRAM = 35, 8
#: Distinct segments of one anchor that a shard takes.
HOT = 2000
#: Texts are worked on in slices of about so many bytes; an automaton takes about so many words, but whole anchors.
SLICE, SHARD_WORDS = 1 << 20, 100_000

_U = np.uint64
_SEGMENTS = "key long, h1 long, h2 long, words binary, n int, places binary"
_SPANS = "h1 long, h2 long, begin int, end int"


def runs_of(t: Texts, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, anchor's hash, first word in the document, and number of windows of every run of windows with one anchor."""
    s, e, doc = t.words()
    none = (np.empty(0, np.int64),) * 4
    if len(s) < window:
        return none
    word = mix64(t.hashes(t.prefix(), s, e))
    hashes = combine(word, gram)
    bits = _U(max(28, len(s).bit_length()))
    packed, size, w = (hashes >> bits) << bits | np.arange(len(hashes), dtype=np.uint64), 1, window - gram + 1
    least = packed
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: size - w], least[w - size :])
    at = np.flatnonzero(doc[: len(least)] == doc[window - 1 :])
    if not len(at):
        return none
    place = (least[at] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    first = np.searchsorted(doc, np.arange(t.n))
    d = doc[at[begin]]
    return d, hashes[place[begin]].view(np.int64), at[begin] - first[d], np.diff(np.append(begin, len(at)))


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE):
                doc, key, first, n = runs_of(Texts(batch["text"].slice(a, b - a)), window, gram)
                ids = np.asarray(batch["doc_id"].slice(a, b - a))[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(key), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["doc_id", "key", "first", "n"],
                )

    return run


def _name(words: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(words, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _table(rows, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _segments(window: int):
    """The words of the candidate runs, joined by spaces; equal segments of a slice are one row with several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], SLICE):
                found: dict[tuple[int, bytes], list[int]] = {}
                for doc_id, text, runs in zip(*(batch[c].slice(a, b - a).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                    words = text.encode().split()
                    for r in runs:
                        segment = b" ".join(words[r["first"] : r["first"] + r["n"] + window - 1])
                        found.setdefault((r["key"], segment), []).extend((doc_id, r["first"]))
                yield _table([(k, *_name(s), s, len(v) // 2, np.array(v, "<i8").tobytes()) for (k, s), v in found.items()], _SEGMENTS)

    return run


class Automaton:
    """The suffix automaton of a set of segments (sequences of symbols) that stand `n` times each."""

    def __init__(self, segments: list[list[int]], n: list[int]):
        self.length, self.link, self.next, self.count = [0], [-1], [{}], [0]
        for segment, times in zip(segments, n, strict=True):
            last = 0
            for symbol in segment:
                last = self._add(last, symbol)
                self.count[last] += times
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]
        # the longest suffix of a state's strings that stands twice or more
        self.again = [0] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.again[v] = self.length[v] if self.count[v] > 1 else self.again[self.link[v]]

    def _add(self, last: int, symbol: int) -> int:
        length, link, follow = self.length, self.link, self.next
        known = follow[last].get(symbol)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._split(last, symbol, known)
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        follow.append({})
        self.count.append(0)
        p = last
        while p >= 0 and symbol not in follow[p]:
            follow[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = follow[p][symbol]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
        return state

    def _split(self, p: int, symbol: int, q: int) -> int:
        copy = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        self.count.append(0)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def statistics(self, segment: list[int]) -> Iterator[int]:
        """For every symbol of a segment the length of the longest string ending there that stands twice or more."""
        state, held, follow, link, length = 0, 0, self.next, self.link, self.length
        for symbol in segment:
            while state and symbol not in follow[state]:
                state = link[state]
                held = length[state]
            if symbol in follow[state]:
                state, held = follow[state][symbol], held + 1
            yield min(held, self.again[state])


def spans_of(statistics: Iterator[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans covered by matches of `window` or more."""
    return unite([(end - m, end) for end, m in enumerate(statistics, 1) if m >= window])


def _shards(window: int):
    """Rows (key, words, n) of whole anchors: the spans (h1, h2, begin, end) of every distinct segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, int]] = {}
        for batch in batches:
            for key, words, n in zip(*(batch[c].to_pylist() for c in ("key", "words", "n")), strict=True):
                segments = held.setdefault(key, {})
                segments[words] = segments.get(words, 0) + n
        keys, at = list(held), 0
        while at < len(keys):
            segments: dict[bytes, int] = {}
            size = 0
            while at < len(keys) and (size < SHARD_WORDS or not segments):
                part = held.pop(keys[at])
                segments |= part
                size += sum(s.count(b" ") + 1 for s in part)
                at += 1
            number: dict[bytes, int] = {}
            coded = [[number.setdefault(w, len(number)) for w in s.split(b" ")] for s in segments]
            automaton = Automaton(coded, list(segments.values()))
            yield _table(
                [(*_name(s), a, b) for s, c in zip(segments, coded, strict=True) for a, b in spans_of(automaton.statistics(c), window)], _SPANS
            )

    return run


def _windows(window: int):
    """The windows of segments: their names, and the segment and first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h1, h2, words, n in zip(*(batch[c].to_pylist() for c in ("h1", "h2", "words", "n")), strict=True):
                w = words.split(b" ")
                rows += [(*_name(b" ".join(w[i : i + window])), h1, h2, i, n) for i in range(len(w) - window + 1)]
            yield _table(rows, "w1 long, w2 long, h1 long, h2 long, begin int, n int")

    return run


def _cut_windows(window: int):
    """The words of the windows of segments that begin at `at`; equal ones of a batch are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, int] = {}
            for words, n, at in zip(*(batch[c].to_pylist() for c in ("words", "n", "at")), strict=True):
                w = words.split(b" ")
                for i in at:
                    segment = b" ".join(w[i : i + window])
                    found[segment] = found.get(segment, 0) + n
            yield _table([(_name(s)[0], s, n) for s, n in found.items()], "key long, words binary, n int")

    return run


def _of_hot(segments: DataFrame, window: int, parts: int) -> DataFrame:
    """Spans of segments with hot anchors."""
    named = cut_lineage(segments.mapInArrow(_windows(window), "w1 long, w2 long, h1 long, h2 long, begin int, n int"))
    again = cut_lineage(named.groupBy("w1", "w2").agg(F.sum("n").alias("_times")).where("_times > 1").select("w1", "w2"))
    kept = cut_lineage(named.join(again, ["w1", "w2"]).select("w1", "w2", "h1", "h2", "begin").distinct())
    lists = kept.groupBy("h1", "h2").agg(F.collect_list("begin").alias("at"))
    texts = segments.join(lists, ["h1", "h2"]).select("words", "n", "at").mapInArrow(_cut_windows(window), "key long, words binary, n int")
    told = cut_lineage(texts.repartition(parts, "key").mapInArrow(_shards(window), _SPANS).select(F.col("h1").alias("w1"), F.col("h2").alias("w2")))
    return kept.join(told, ["w1", "w2"]).select("h1", "h2", "begin", (F.col("begin") + window).alias("end"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of segments at all places of the segments."""
    for batch in batches:
        places = [np.frombuffer(p, "<i8").reshape(-1, 2) for p in batch["places"].to_pylist()]
        n = [len(p) for p in places]
        at = np.concatenate(places) if places else np.empty((0, 2), np.int64)
        begin, end = (at[:, 1] + np.repeat(np.asarray(batch[c]).astype(np.int64), n) for c in ("begin", "end"))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (at[:, 0], begin, end)], names=["doc_id", "begin", "end"])


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, begin, end): ranges of words, overlapping and possibly several times, that stand elsewhere too.

    doc_id must be unique and not null; text must not be null.
    """
    parts = 4 * max(1, docs.rdd.getNumPartitions())
    runs = cut_lineage(docs.mapInArrow(_runs(window, gram), "doc_id long, key long, first int, n int"))
    # written, as below: a join of two written tables is one that adaptive execution splits where an anchor is hot
    again = cut_lineage(runs.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("key"))
    chosen = cut_lineage(runs.join(again, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "n")).alias("runs")))
    texts = docs.join(chosen, "doc_id").select("doc_id", "text", "runs")
    segments = cut_lineage(texts.mapInArrow(_segments(window), _SEGMENTS))
    many = segments.select("key", "h1", "h2").distinct().groupBy("key").count().where(F.col("count") > hot).select("key")
    many = cut_lineage(many)
    few = segments.join(many, "key", "left_anti").select("key", "words", "n").repartition(parts, "key")
    spans = few.mapInArrow(_shards(window), _SPANS)
    if not many.isEmpty():
        spans = spans.union(_of_hot(segments.join(many, "key", "left_semi"), window, parts))
    # written, so that the join below is one that adaptive execution splits where a segment has very many places
    spans = cut_lineage(spans)
    placed = segments.select("h1", "h2", "places").join(spans, ["h1", "h2"]).select("places", "begin", "end")
    return placed.mapInArrow(_places, "doc_id long, begin long, end long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch["text"], SLICE):
            rows = []
            for text, begins, ends in zip(*(batch.slice(a, b - a)[c].to_pylist() for c in ("text", "begins", "ends")), strict=True):
                words, kept, at = text.encode().split(), [], 0
                for x, y in unite(list(zip(begins or [], ends or [], strict=True))):
                    kept += words[at:x]
                    at = y
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def without_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row.

    A null text is empty. Rows with null or repeated ids are documents of their own, so of equal rows of `window` words
    or more none keeps its words. Documents with fewer words lose nothing, also if they are equal. An empty table gives
    an empty result; other columns are ignored.
    """
    ship_package()
    rows, given = with_unique_ids(docs)
    spans = repeated_words(rows, window, gram, hot).groupBy("doc_id").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    told = rows.join(spans, "doc_id", "left").select("doc_id", "text", "begins", "ends")
    out = told.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    if given is None:
        return out
    return out.join(given, out["doc_id"] == given["_row"]).select(F.col("_given").alias("doc_id"), *out.columns[1:])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM x) WHERE c > 1),
g AS (SELECT doc_id, list(i) AS at FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(at), 0) AS n_removed,
        CASE WHEN at IS NULL THEN w ELSE list_filter(w, lambda v, j : NOT list_contains(at, j)) END AS kept
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
