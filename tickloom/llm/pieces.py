"""SentencePiece encoding and decoding by suffix-array matching.

The distinct space-led words of a batch are concatenated and their suffixes sorted. Every piece of the vocabulary is
searched in the suffixes by bisection; the range it gets lists all places where it stands. Each place is an edge of
the words' lattices; edges are sorted by the position where they end and relaxed in that order.

For a byte-pair model the relaxation is a test instead of a sum of scores: the encoding of a prefix that ends in piece
b is the encoding of the prefix before b, ending in a, plus b, exactly if the string ab by itself is encoded as a, b.
One edge into each position passes, so following the edges back from the end of a word gives the model's own result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.grams import slices
from tickloom.llm.text import table

#: A vocabulary file; every function takes the path as a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct words are indexed in batches of about so many bytes.
INDEX_BYTES = 250_000
MARK = "▁"
#: A worker remembers which pairs of pieces may follow each other: in so many slots, and behind them so many pairs.
SLOTS, MOST_PAIRS = 1 << 20, 400_000

_WORDS = re.compile(" *[^ \n]+| +|\n")


class Vocabulary(NamedTuple):
    """Pieces with a space for the mark. `rank` orders merges; byte ids encode characters outside the vocabulary."""

    text: list[bytes]
    ids: np.ndarray
    rank: dict[str, int]
    byte_ids: np.ndarray
    output: list[bytes]


def load(path: str = MODEL) -> Vocabulary:
    """Reads a byte-pair model with byte fallback whose normaliser leaves texts as they are."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    byte_ids, output, plain = np.zeros(256, np.int32), [], []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            b = int(p[3:5], 16)
            byte_ids[b] = i
            output.append(bytes([b]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            output.append(b"")
        else:
            output.append(p.replace(MARK, " ").encode())
            plain.append((i, p.replace(MARK, " ")))
    rank = {p: n for n, (_, p) in enumerate(sorted(plain, key=lambda x: (-sp.get_score(x[0]), x[0])))}
    # a piece that its own string is not encoded to never occurs in an encoding
    used = [(i, p) for i, p in plain if len(p) == 1 or merge(p, rank) == [p]]
    return Vocabulary([p.encode() for _, p in used], np.array([i for i, _ in used], np.int32), rank, byte_ids, output)


def merge(text: str, rank: dict[str, int]) -> list[str]:
    """The byte-pair encoding of a short string: the best-ranked neighbours merge until none can."""
    parts = list(text)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Encoder:
    """Encodes batches of words; keeps which pairs of pieces may stand side by side."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        n = len(vocabulary.text)
        self.size = np.array([len(p) for p in vocabulary.text])
        padded = np.zeros((n, 16), np.uint8)
        for i, p in enumerate(vocabulary.text):
            padded[i, : min(16, len(p))] = np.frombuffer(p[:16], np.uint8)
        full = np.where(np.arange(16) < self.size[:, None], padded, 255).astype(np.uint8)
        self.low = padded.view(">u8").astype(np.uint64)
        self.high = full.view(">u8").astype(np.uint64)
        self.n = n
        self.may: dict[int, bool] = {}
        self.slot_key, self.slot_may = np.full(SLOTS, -1), np.zeros(SLOTS, bool)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pieces a and b: is the string ab encoded as a, b?"""
        pair = a * self.n + b
        slot = (pair * 0x9E3779B1 >> 7) & (SLOTS - 1)
        out = self.slot_may[slot]
        new = np.flatnonzero(self.slot_key[slot] != pair)
        if len(new):
            keys, at = np.unique(pair[new], return_inverse=True)
            found = np.fromiter(map(self.may_follow, keys.tolist()), bool, len(keys))
            out[new] = found[at]
            slot = (keys * 0x9E3779B1 >> 7) & (SLOTS - 1)
            slot, last = np.unique(slot, return_index=True)  # one key for each slot
            self.slot_key[slot], self.slot_may[slot] = keys[last], found[last]
        return out

    def may_follow(self, pair: int) -> bool:
        known = self.may.get(pair)
        if known is None:
            x, y = (self.v.text[k].decode() for k in divmod(pair, self.n))
            if len(self.may) >= MOST_PAIRS:
                self.may.clear()
            known = self.may[pair] = merge(x + y, self.v.rank) == [x, y]
        return known

    def edges(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every piece: its first byte and its number. `first` are the first bytes of characters."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
        word = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            word = (word << np.uint64(8)) | padded[j : j + len(word)]
        k0, k1 = word[first], word[first + 8]
        order = np.lexsort((k1, k0))
        k0, k1 = k0[order], k1[order]
        lo = bisect(k0, k1, self.low[:, 0], self.low[:, 1], False)
        hi = bisect(k0, k1, self.high[:, 0], self.high[:, 1], True)
        n = hi - lo
        piece = np.repeat(np.arange(self.n), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at = first[order[place]]
        long = np.flatnonzero(self.size[piece] > 16)
        if len(long):
            raw = data.tobytes()
            wrong = [i for i in long.tolist() if not raw.startswith(self.v.text[piece[i]], int(at[i]))]
            at, piece = np.delete(at, wrong), np.delete(piece, wrong)
        return at, piece

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's ids begin (and the end)."""
        data = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size + 1) - size - 1
        first = np.flatnonzero((data & 0xC0) != 0x80)
        at, piece = self.edges(data, first)
        # characters that no piece covers stand for themselves
        alone = np.zeros(len(data), bool)
        alone[first] = True
        char_end = np.zeros(len(data), np.int64)
        char_end[first] = np.append(first[1:], len(data))
        end = at + self.size[piece]
        alone[at[end == char_end[at]]] = False
        alone[begin + size] = False
        lone = np.flatnonzero(alone)
        start, end = np.concatenate([at, lone]), np.concatenate([end, char_end[lone]])
        token = np.concatenate([piece, np.full(len(lone), self.n)])
        offset = end - np.repeat(begin, size + 1)[start]
        order = np.argsort(offset, kind="stable")
        start, end, token, offset = start[order], end[order], token[order], offset[order]
        last = np.full(len(data) + 1, -2)
        last[begin] = -1
        back = np.full(len(data) + 1, -1)
        cuts = np.flatnonzero(np.diff(offset, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, t, before = start[a:b], token[a:b], last[start[a:b]]
            ok = (before == -1) | ((before >= 0) & ((before == self.n) | (t == self.n)))
            ask = np.flatnonzero((before >= 0) & ~ok)
            if len(ask):
                ok[ask] = self.fits(before[ask], t[ask])
            good = np.flatnonzero(ok)
            last[end[a:b][good]] = t[good]
            back[end[a:b][good]] = s[good]
        return self._follow(data, begin, size, last, back)

    def _follow(self, data, begin, size, last, back) -> tuple[np.ndarray, np.ndarray]:
        """Walks all words back from their ends at once and lists their ids."""
        word, pos = np.flatnonzero(size), (begin + size)[size > 0]
        found = []
        while len(pos):
            found.append((word, back[pos], pos, last[pos]))
            pos = back[pos]
            going = pos > begin[word]
            word, pos = word[going], pos[going]
        word, a, b, token = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int),) * 4
        order = np.argsort(a, kind="stable")
        word, a, b, token = word[order], a[order], b[order], token[order]
        n = np.where(token == self.n, b - a, 1)
        ids = np.repeat(np.append(self.v.ids, 0)[token], n)
        lone = np.repeat(token == self.n, n)
        if lone.any():
            byte = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[lone] = self.v.byte_ids[data[byte[lone]]]
        total = np.bincount(word, weights=n, minlength=len(size)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(total)])

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin (and the end)."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        codes = [
            np.fromiter(map(number.__getitem__, _WORDS.findall(" " + t.replace(MARK, " "))), np.int64) if t else np.empty(0, np.int64)
            for t in texts
        ]
        words = [w.encode() for w in number]
        ids, starts, at, a = [], [], 0, 0
        while a < len(words):
            b, n = a, 0
            while b < len(words) and (n < INDEX_BYTES or b == a):
                n += len(words[b]) + 1
                b += 1
            if words[a] == b"\n":
                b = a + 1
                got, cut = self.v.byte_ids[[10]], np.array([0, 1])
            else:
                if b"\n" in words[a:b]:
                    b = words.index(b"\n", a)
                got, cut = self.words(words[a:b])
            ids.append(got)
            starts.append(cut[:-1] + at)
            at += len(got)
            a = b
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        begin = np.append(np.concatenate(starts), at) if starts else np.zeros(1, np.int64)
        code = np.concatenate(codes) if codes else np.empty(0, np.int64)
        n = begin[code + 1] - begin[code] if len(code) else np.empty(0, np.int64)
        take = np.arange(n.sum()) + np.repeat(begin[code] - (np.cumsum(n) - n), n) if len(code) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, codes)])]
        return flat[take], ends


def bisect(k0: np.ndarray, k1: np.ndarray, q0: np.ndarray, q1: np.ndarray, right: bool) -> np.ndarray:
    """For each query pair the number of sorted key pairs before it (or, with right, not after it)."""
    lo, hi = np.zeros(len(q0), np.int64), np.full(len(q0), len(k0), np.int64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, max(len(k0) - 1, 0))
        a, b = k0[mid], k1[mid]
        before = (a < q0) | ((a == q0) & ((b <= q1) if right else (b < q1)))
        lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
    return lo


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of a sequence of ids; ids that are no pieces (control, unknown) have none."""
    raw = b"".join(map(vocabulary.output.__getitem__, ids.tolist()))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_worker: dict[str, Encoder] = {}


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: one row per input row.

    round_trip says that the decoded ids are the text again (U+2581 reads as a space). A null or empty text has no
    ids. Repeated rows are encoded one by one; an empty table gives an empty result; other columns are ignored. The
    vocabulary is read once on the driver and sent to the tasks.
    """
    vocabulary = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker.setdefault(path, Encoder(vocabulary))
        for batch in batches:
            for a, b in slices(batch["text"], 6 << 20):
                part = batch.slice(a, b - a)
                texts = part["text"].to_pylist()
                ids, cut = encoder.texts(texts)
                back = [decode(ids[cut[i] : cut[i + 1]], vocabulary) == (t or "").replace(MARK, " ") for i, t in enumerate(texts)]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(np.diff(cut), pa.int64()), lists, pa.array(back, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids are the empty text."""
    vocabulary = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(np.array(v or [], np.int64), vocabulary) for v in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
