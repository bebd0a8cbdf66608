"""Alignment of two tokenizers over a corpus by inverted bitmaps of token pairs.

A text is encoded by both tokenizers; where a token of each ends at one byte, the two are linked.

1. *Postings.* Rows are numbered, and 65,536 numbers are a block. Per block, a pair of ids has bit planes: plane k is the
   set of rows in which bit k of the pair's number of links is set. A set is compressed: up to 4,096 rows are their
   16-bit numbers, more are a bitmap of 8 KB.
2. *Merge.* Planes of one pair and block that come from different parts of the texts are joined by OR. Their population
   counts give a pair's links (plane k counts 2^k), that of the OR of all planes its documents. Nothing grows with
   a pair: a block's planes are bounded, and only numbers are added up over blocks.
3. *Scores.* Counts go back along the postings: each plane hands its pair's count to the rows that it holds, block by
   block, into arrays of one number per row of the block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm.grams import slices
from tickloom.llm.text import table
from tickloom.session import cut_lineage, ship_package

#: Vocabulary files; every function takes the paths as parameters.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how the byte-level vocabulary cuts texts before it merges.
CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are aligned in slices of about so many bytes; postings of a task are put out when there are so many.
SLICE, MOST_POSTINGS = 2 << 20, 4_000_000
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
#: Rows above which a set is a bitmap.
SPARSE = 4096
SPACE = b" "

_ROWS = "kind byte, row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a int, b int, block long, plane byte, bits binary"
_PLANES = "a int, b int, block long, plane byte, bits binary"
_MERGED = f"{_PLANES}, rows long, docs long"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """The bytes of all ids: where they begin in one array, and their lengths."""

    def __init__(self, output: list[bytes]):
        self.output = output
        self.size = np.array([len(x) for x in output], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(output), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.bytes[np.arange(n.sum()) + np.repeat(self.begin[ids] - (np.cumsum(n) - n), n)]


class Pair:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, byte_json: str, piece_model: bytes):
        told, letters = json.loads(byte_json), _byte_letters()
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, k)): i for k, i in told["model"]["vocab"].items() if k not in special}
        output = [b""] * (max(told["model"]["vocab"].values()) + 1)
        for x, i in ranks.items():
            output[i] = x
        self.a = Tokens(output)
        self.fast = tiktoken.Encoding("pair", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.json, self.plain = byte_json, None
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        as_bytes = lambda i: bytes([int(self.sp.id_to_piece(i)[3:5], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace("▁", " ").encode()
        self.b = Tokens([as_bytes(i) for i in range(self.sp.get_piece_size())])
        # decimal ids with what follows them: "," inside a group, "|" after its A ids, ";" after its B ids
        na, nb = len(self.a.output), len(self.b.output)
        self.spelled = np.array([f"{i}{x}" for n, ends in ((na, ",|"), (nb, ",;")) for x in ends for i in range(n)], object)

    def encode_a(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        except ValueError:  # white space too long for that library's patterns
            if self.plain is None:
                self.plain = Tokenizer.from_str(self.json)
                self.plain.encode_special_tokens = True
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B one after the other, and how many each text has; none for texts that a side changes."""
        held = [i for i, t in enumerate(texts) if t]
        ours = [self.encode_a(" " + texts[i]) for i in held]
        theirs = [np.array(x, np.int32) for x in self.sp.encode([texts[i] for i in held], num_threads=1)] if held else []
        n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        good_a, good_b = [], []
        for i, x, y in zip(held, ours, theirs, strict=True):
            raw = SPACE + texts[i].encode()
            whole = lambda v, t, raw=raw: int(t.size[v].sum()) == len(raw) and t.spell(v).tobytes() == raw
            if whole(x, self.a) and whole(y, self.b):
                n_a[i], n_b[i] = len(x), len(y)
                good_a.append(x)
                good_b.append(y)
        flat = lambda v: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64)
        return flat(good_a), flat(good_b), n_a, n_b

    def align(self, texts: list[str | None]):
        """n_a, n_b, n_groups and digest per text; text, A id and B id per link."""
        a, b, n_a, n_b = self.encode(texts)
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        total = int(end_a[-1]) if len(a) else 0
        place = np.full(total + 1, -1)
        place[end_b] = np.arange(len(b))
        of_b = place[end_a]
        link_a = np.flatnonzero(of_b >= 0)
        link_b = of_b[link_a]
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[link_a] = last_b[link_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        at_a = np.arange(len(a)) + np.concatenate([[0], link_b + 1])[group_a]
        at_b = np.arange(len(b)) + (link_a + 1)[group_b]
        codes = np.empty(len(a) + len(b), np.int64)
        na, nb = len(self.a.output), len(self.b.output)
        codes[at_a] = a + na * last_a
        codes[at_b] = b + nb * last_b + 2 * na
        doc = np.repeat(np.arange(len(texts)), n_a)[link_a]
        n_groups = np.bincount(doc, minlength=len(texts))
        cut = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        digest = [
            hashlib.sha256("".join(self.spelled[codes[i:j]].tolist())[:-1].encode()).hexdigest() if j > i else ""
            for i, j in zip(cut[:-1], cut[1:], strict=True)
        ]
        return n_a, n_b, n_groups, digest, doc, a[link_a], b[link_b]


def _to_bitmap(rows: np.ndarray) -> bytes:
    flag = np.zeros(BLOCK, np.uint8)
    flag[rows] = 1
    return np.packbits(flag, bitorder="little").tobytes()


def packed(rows: np.ndarray) -> bytes:
    """A set of sorted 16-bit numbers, compressed."""
    return rows.astype("<u2").tobytes() if len(rows) < SPARSE else _to_bitmap(rows)


def unpacked(bits: bytes) -> np.ndarray:
    """The sorted numbers of a set; only a bitmap is 8 KB long."""
    if len(bits) == BLOCK // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    return np.frombuffer(bits, "<u2").astype(np.int64)


def united(sets: list[bytes]) -> bytes:
    """The OR of compressed sets."""
    if len(sets) == 1:
        return sets[0]
    flag = np.zeros(BLOCK, bool)
    for bits in sets:
        flag[unpacked(bits)] = True
    return packed(np.flatnonzero(flag))


def count(bits: bytes) -> int:
    if len(bits) == BLOCK // 8:
        return int(np.bitwise_count(np.frombuffer(bits, np.uint64)).sum())
    return len(bits) // 2


def _plane_rows(pair: np.ndarray, row: np.ndarray, links: np.ndarray, n_b: int) -> Iterator[pa.RecordBatch]:
    """Postings, sorted by pair and row, as one set for each pair, block and plane."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    for plane in range(int(links.max()).bit_length()):
        held = np.flatnonzero(links >> plane & 1)
        if not len(held):
            continue
        p, r = pair[held], row[held]
        block = r >> BLOCK_BITS
        begin = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (block[1:] != block[:-1])]))
        ends = np.append(begin[1:], len(held))
        low = (r & (BLOCK - 1)).astype("<u2")
        many = ends - begin >= SPARSE
        if many.any():
            bits = pa.array([packed(low[x:y]) for x, y in zip(begin, ends, strict=True)], pa.binary())
        else:
            offsets = pa.py_buffer(np.append(begin, len(held)).astype(np.int32) * 2)
            bits = pa.Array.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(low)])
        m = len(begin)
        none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
        keys = [pa.array(v) for v in ((p[begin] // n_b).astype(np.int32), (p[begin] % n_b).astype(np.int32), block[begin], np.full(m, plane, np.int8))]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), *none, *keys, bits], names=names)


def _postings(byte_json: str, piece_model: bytes):
    """A row per document (kind 0), and the planes of its part of the texts (kind 1)."""
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = Pair(byte_json, piece_model)
        n_b, number, held, size = len(two.b.output), TaskContext.get().partitionId() << 33, [], 0

        def put_out() -> Iterator[pa.RecordBatch]:
            key, links = (np.concatenate(v) for v in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, links = key[order], links[order]
            # rows of a flush differ in their low 32 bits only
            yield from _plane_rows(key >> 32, (number - 1) >> 32 << 32 | (key & 0xFFFFFFFF), links, n_b)

        for batch in batches:
            for x, y in slices(batch["text"], SLICE):
                n_a, n_bs, n_groups, digest, doc, a, b = two.align(batch["text"].slice(x, y - x).to_pylist())
                m = y - x
                if held and (number + m - 1) >> 32 != number >> 32:
                    yield from put_out()
                    held, size = [], 0
                row = number + np.arange(m)
                number += m
                columns = [np.zeros(m, np.int8), row, batch["doc_id"].slice(x, m), n_a, n_bs, n_groups]
                none = [pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int8(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns), pa.array(digest), *none], names=names)
                if len(doc):
                    found, links = np.unique((a * n_b + b) << 32 | (row[doc] & 0xFFFFFFFF), return_counts=True)
                    held.append((found, links))
                    size += len(found)
                if size >= MOST_POSTINGS:
                    yield from put_out()
                    held, size = [], 0
        if held:
            yield from put_out()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair, block and plane: one set for each, its count, and with plane rows the documents of the pair in
    the block (with the first of its planes; 0 with the others)."""

    def merged(key: tuple, planes: list[tuple[int, bytes]]) -> Iterator[tuple]:
        by_plane: dict[int, list[bytes]] = {}
        for plane, bits in planes:
            by_plane.setdefault(plane, []).append(bits)
        sets = {k: united(v) for k, v in sorted(by_plane.items())}
        docs = count(united(list(sets.values())))
        for k, bits in sets.items():
            yield (*key, k, bits, count(bits), docs)
            docs = 0

    def rows() -> Iterator[tuple]:
        now, planes = None, []
        for batch in batches:
            for a, b, block, plane, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b, block) != now:
                    if planes:
                        yield from merged(now, planes)
                    now, planes = (a, b, block), []
                planes.append((plane, bits))
        if planes:
            yield from merged(now, planes)

    types = [pa.int32(), pa.int32(), pa.int64(), pa.int8(), pa.binary(), pa.int64(), pa.int64()]
    names = ["a", "b", "block", "plane", "bits", "rows", "docs"]
    part, size = [], 0
    for row in rows():
        part.append(row)
        size += len(row[4]) + 64
        if size > SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block (block, plane, bits, links, best): the sums of every row of a block."""
    now, best, total = None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

    def told() -> pa.RecordBatch:
        held = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array((now << BLOCK_BITS) + held), pa.array(best[held]), pa.array(total[held])], names=["row", "n_best", "count_sum"])

    for batch in batches:
        block = np.asarray(batch["block"])
        cuts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1, append=block[-1:] + 1)).tolist() if len(block) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if now != int(block[x]):
                if now is not None:
                    yield told()
                now = int(block[x])
                best[:] = total[:] = 0
            part = batch.slice(x, y - x)
            bits = part["bits"]
            size = np.asarray(pc.binary_length(bits)).astype(np.int64)
            weight = np.int64(1) << np.asarray(part["plane"]).astype(np.int64)
            value, first = weight * np.asarray(part["links"]), np.where(part["best"].to_numpy(zero_copy_only=False), weight, 0)
            few = np.flatnonzero(size < BLOCK // 8)
            at = np.frombuffer(b"".join(bits.take(pa.array(few)).to_pylist()), "<u2") if len(few) else np.empty(0, np.int64)
            np.add.at(total, at, np.repeat(value[few], size[few] // 2))
            np.add.at(best, at, np.repeat(first[few], size[few] // 2))
            for i in np.flatnonzero(size == BLOCK // 8).tolist():
                at = unpacked(bits[i].as_py())
                total[at] += value[i]
                best[at] += first[i]
    if now is not None:
        yield told()


class Alignment:
    """The written tables of an alignment.

    `rows` are the documents, `planes` the merged sets of all pairs, `pairs` (a, b, n_docs, n_links, best) the pairs:
    best says that no pair of this B id has more links.
    """

    def __init__(self, docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE):
        ship_package()
        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        run = _postings(Path(byte_bpe).read_text(encoding="utf-8"), Path(piece_bpe).read_bytes())
        found = cut_lineage(texts.mapInArrow(run, _ROWS))
        self.rows = found.where("kind = 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
        parts = found.where("kind = 1").select("a", "b", "block", "plane", "bits")
        dealt = parts.repartition("a", "b", "block").sortWithinPartitions("a", "b", "block", "plane")
        self.planes = cut_lineage(dealt.mapInArrow(_merge, _MERGED))
        links = F.sum(F.expr("rows * shiftleft(1L, plane)"))
        pairs = self.planes.groupBy("a", "b").agg(F.sum("docs").alias("n_docs"), links.alias("n_links"))
        most = pairs.groupBy("b").agg(F.max("n_links").alias("_most"))
        self.pairs = cut_lineage(pairs.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_most")).alias("best")))

    def scores(self) -> DataFrame:
        """row, n_best, count_sum of every document with links."""
        counts = self.pairs.select("a", "b", F.col("n_links").alias("links"), "best")
        given = self.planes.join(counts, ["a", "b"]).select("block", "plane", "bits", "links", "best")
        dealt = given.repartition("block").sortWithinPartitions("block")
        return dealt.mapInArrow(_scores, "row long, n_best long, count_sum long")


def token_links(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per input row.

    A text that is null, empty or changed by a tokenizer (one with U+2581) has no tokens: zeros and an empty digest. Rows
    are told apart by numbers of their own, so null and repeated ids and repeated rows are aligned one by one. Pairs of
    equal counts are all best. An empty table gives an empty result; other columns are ignored.
    """
    found = Alignment(docs, byte_bpe, piece_bpe)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.rows.join(found.scores(), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(table(spark, sf_dir, "documents"))
