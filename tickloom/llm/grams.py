"""Vectorised views of Arrow text batches: words, characters and 64-bit hashes of any stretch of bytes.

All hashes come from one prefix sum: with a random 64-bit number T[b] per byte value and an odd base B,
P[i] = sum of T[byte k] * B^k for k < i, and the hash of bytes s..e is (P[e] - P[s]) * B^-s, all modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, which bounds memory; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word."""
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """B^k and B^-k, kept by the worker and grown to the longest slice seen."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 4096)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.cumprod(p))
        return cls.up[:n], cls.down[:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have about `limit` bytes; every row is in one range."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


class Texts:
    """The texts of one slice as bytes with document offsets; null is the empty text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        raw = raw[offsets[0] : offsets[-1]]
        self.bytes = _LOWER[raw] if lower else raw
        self.offsets = (offsets - offsets[0]).astype(np.int64)
        self.n = len(texts)

    @property
    def starts_doc(self) -> np.ndarray:
        """A flag per byte (and one after the end): a document begins here."""
        flag = np.zeros(len(self.bytes) + 1, bool)
        flag[self.offsets] = True
        return flag

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and document of every word."""
        word = ~_SPACE[self.bytes]
        first = self.starts_doc
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | first[1:-1]
        ends[:-1] &= ~word[1:] | first[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return s, e, self.document_of(s)

    def document_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, position, "right") - 1

    def characters(self) -> np.ndarray:
        """First bytes of all characters."""
        return np.flatnonzero((self.bytes & 0xC0) != 0x80)

    def per_document(self, flag: np.ndarray) -> np.ndarray:
        """How many bytes of each document carry the flag."""
        run = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def prefix(self) -> np.ndarray:
        up, _ = _Powers.get(len(self.bytes) + 1)
        run = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[:-1], out=run[1:])
        return run

    @staticmethod
    def hashes(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        _, down = _Powers.get(len(prefix))
        return mix64((prefix[e] - prefix[s]) * down[s])

    def is_space(self) -> np.ndarray:
        return _SPACE[self.bytes]


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbours."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return out
