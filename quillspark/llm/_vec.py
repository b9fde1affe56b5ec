"""Vectorised text primitives over Arrow string buffers.

Every routine works on the UTF-8 bytes of many texts at once.  Word separators
are the ASCII bytes 0x20 and 0x09-0x0D, so words can be found bytewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False
#: Letters, digits and all of non-ASCII; punctuation parts words too.
IS_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(U64)
        x = (x + U64(0x9E3779B97F4A7C15)).astype(U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_POSITIONS = 512
_TABLE = mix64(np.arange(_POSITIONS)) | U64(1)
_BYTES = mix64(np.arange(256) + 1_000_003)
_BYTES[list(SEPARATORS)] = 0


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (lo, hi, bytes, offsets) of whole texts, of about `limit` bytes; a longer text is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of a run of texts: byte bounds, and per text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IS_WORD):
        self.data, self.offsets = data, offsets
        self.table = _BYTES * inside.astype(U64)
        inside = inside[data]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            before[heads] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.inside = inside
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def ends(self) -> np.ndarray:
        after = np.zeros_like(self.inside)
        if len(after):
            after[:-1] = self.inside[1:]
            tails = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
            after[tails] = False
        return np.flatnonzero(self.inside & ~after) + 1

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit multilinear hash of each word's bytes."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, U64)
        base = int(self.starts[0])
        spans = np.diff(np.append(self.starts, n))
        at = np.arange(base, n) - np.repeat(self.starts, spans)
        if int(spans.max()) <= _POSITIONS:
            factor = _TABLE[at]
        else:
            factor = _TABLE[at % _POSITIONS] + mix64(at // _POSITIONS) * (at >= _POSITIONS).astype(U64) * U64(2)
        values = (self.table[LOWER] if lower else self.table)[self.data[base:]]
        with np.errstate(over="ignore"):
            return mix64(np.add.reduceat(values * factor, self.starts - base))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word position) of each run of n words that stays inside one text."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    with np.errstate(over="ignore"):
        h = hashes[ok]
        for k in range(1, n):
            h = mix64(h * U64(0x9E3779B97F4A7C15) + hashes[ok + k])
    return h, doc[ok], ok - first[doc[ok]]


def text_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values by text; first[i]:first[i+1] is the range of text i."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def sum_ranges(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """As text_sums, but each range is summed by itself, so that a text's sum doesn't depend on its neighbours."""
    out = np.zeros(len(first) - 1, dtype=values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, inverse) as np.unique; short runs of narrow keys are sorted together with their places, which is faster."""
    room = 64 - bits
    if len(keys) >= 1 << min(room, 62):
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys << U64(room)) | np.arange(len(keys), dtype=U64))
    place = (both & U64((1 << room) - 1)).astype(np.int64)
    value = both >> U64(room)
    head = np.empty(len(value), bool)
    head[:1] = True
    head[1:] = value[1:] != value[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[place] = np.cumsum(head) - 1
    return value[head], inverse
