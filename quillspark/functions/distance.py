"""Edit distances of many pairs at once, exact: Myers' bit vectors, with the pairs of a block side by side in one integer.

A pair's shorter sequence has a slot of bits, one a symbol and a spare one that stops carries; each step takes the next
symbol of every pair.  So a step costs a few operations on whole integers, whether a block holds many short pairs or one long.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Bits of a block's slots and symbols of its longer texts, where a single pair has no more; bytes of its table of symbols, beyond which one is built a step at a time.
BLOCK_BITS, BLOCK_STEPS, TABLE_BYTES = 1 << 17, 1 << 21, 1 << 24


def distances(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Edit distances of the sequences a[a_at[i]:a_at[i + 1]] and b[b_at[i]:b_at[i + 1]] of symbols 0, 1, 2 and so on."""
    sizes = np.diff(a_at), np.diff(b_at)
    out = np.maximum(*sizes).astype(np.int64)
    swap = sizes[0] > sizes[1]
    start, other = np.where(swap, b_at[:-1] + len(a), a_at[:-1]), np.where(swap, a_at[:-1], b_at[:-1] + len(a))
    m, n = np.minimum(*sizes), np.maximum(*sizes)
    symbols = np.concatenate([a, b]).astype(np.int64)
    words = (m + 64) // 64
    order = np.lexsort((words, n))
    order = order[m[order] > 0]
    i = 0
    while i < len(order):
        # Pairs of a block are alike in length, so that few steps are lost on those that end early.
        longest = int(n[order[i]]) * 5 // 4 + 32
        block = order[i : i + max(1, BLOCK_STEPS // longest)]
        block = block[n[block] <= longest]
        width = np.maximum.accumulate(words[block])
        block = block[: max(1, int(np.searchsorted(width * np.arange(1, len(block) + 1) * 64, BLOCK_BITS, "right")))]
        out[block] = _block(symbols, start[block], m[block], other[block], n[block], int(width[len(block) - 1]))
        i += len(block)
    return out


def _flat(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, place in it) of all symbols of the pairs, in order."""
    pair = np.repeat(np.arange(len(size)), size)
    return pair, np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)


def _block(symbols: np.ndarray, start: np.ndarray, m: np.ndarray, other: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Distances of a block's pairs, whose n rise, in slots of so many words of 64 bits."""
    count, base = len(m), int(symbols.max()) + 1
    pair, place = _flat(start, m)
    keys, row = np.unique(pair * base + symbols[start[pair] + place], return_inverse=True)
    q, at = _flat(other, n)
    wanted = q * base + symbols[other[q] + at]
    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = np.where(keys[found] == wanted, found + 1, 0)
    steps = np.zeros((int(n[-1]), count), np.int64)
    steps[at, q] = found
    bit = np.left_shift(np.uint64(1), (place % 64).astype(np.uint64))
    if (len(keys) + 1) * width * 8 <= TABLE_BYTES:
        table = np.zeros(((len(keys) + 1) * width,), np.uint64)
        np.add.at(table, (row + 1) * width + place // 64, bit)
        table = table.reshape(-1, width)
        equal = lambda j: table[steps[j]]
    else:
        by_row = np.argsort(row, kind="stable")
        first = np.concatenate([[0, 0], np.cumsum(np.bincount(row, minlength=len(keys)))])

        def equal(j: int) -> np.ndarray:
            now = np.zeros((count, width), np.uint64)
            for r in steps[j][steps[j] > 0]:
                i = by_row[first[r] : first[r + 1]]
                np.add.at(now, (pair[i], place[i] // 64), bit[i])
            return now

    whole = lambda x: int.from_bytes(x.tobytes(), "little")
    slots = np.full((count, width), np.uint64(2**64 - 1))
    slots[:, -1] >>= np.uint64(1)
    low = np.zeros((count, width), np.uint64)
    low[:, 0] = 1
    bits = np.arange(width * 64).reshape(width, 64)
    mask, low = whole(slots), whole(low)
    up, down, ends, out = mask, 0, set(n.tolist()), np.zeros(count, np.int64)
    for j in range(int(n[-1])):
        eq = whole(equal(j))
        same = ((((eq & up) + up) ^ up) | eq | down) & mask
        right = ((down | (mask ^ (same | up))) << 1) | low
        up = (((same & up) << 1) | (mask & ~(same | right))) & mask
        down = right & same
        if j + 1 in ends:
            done = np.flatnonzero(n == j + 1)
            ups, downs = (np.frombuffer(x.to_bytes(count * width * 8, "little"), np.uint64).reshape(count, width)[done] for x in (up, down))
            # Of the last word in use, the bits within the sequence; of those before, all.
            left = np.clip(m[done][:, None] - bits[:, 0], 0, 64).astype(np.uint64)
            used = np.where(left == 64, np.uint64(2**64 - 1), (np.uint64(1) << (left % np.uint64(64))) - np.uint64(1))
            out[done] = n[done] + np.bitwise_count(ups & used).sum(axis=1).astype(np.int64) - np.bitwise_count(downs & used).sum(axis=1).astype(np.int64)
    return out


def _offsets(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


def of_texts(a: list[str], b: list[str]) -> np.ndarray:
    """Distances by code points."""
    points = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]
    return distances(points[0], _offsets([len(x) for x in a]), points[1], _offsets([len(x) for x in b]))


def of_words(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Distances by words."""
    flat = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    sizes = [x.value_lengths().fill_null(0).to_pylist() for x in (a, b)]
    cut = sum(sizes[0])
    return distances(flat[:cut], _offsets(sizes[0]), flat[cut:], _offsets(sizes[1]))


def _whole(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Which pairs are whole."""
    return a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)


@cache
def text_distance():
    """UDF: edit distance of two texts by code points, null where one is."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        both = _whole(a, b)
        x, y = a.to_pylist(), b.to_pylist()
        differ = [i for i in range(len(x)) if both[i] and x[i] != y[i]]
        out = np.zeros(len(x), np.int32)
        if differ:
            out[differ] = of_texts([x[i] for i in differ], [y[i] for i in differ])
        return pa.array(out, mask=~both)

    return run


@cache
def word_distance():
    """UDF: edit distance of two arrays of words of any length, null where one is."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(of_words(a, b).astype(np.int32), mask=~_whole(a, b))

    return run
