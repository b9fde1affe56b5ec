"""Words that a recognizer could have read for others: hashes that two such words share, and what pairs of words differ in; for blocks of words at once.

A hash is a sum over a word's characters, each mixed and weighed by its place, so those of all its parts are differences of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Letters that look alike, in either order, and letters that are lost or gained.
CONFUSED = "ac ae ao bh bp ce co do eo ft gq hn ij il in it mn nr nu rv uv vw vy".split()
LOST = "abcdefghijlmnopqrtuvwy"
#: From this length on, words one edit apart share an intact part; left-out letters grow with a word's length squared.
LONG = 32
#: Characters worked on at once, or a single word's.
CHARACTERS = 1 << 20
#: What two words differ in: one edit or swap that is not plausible, one that is, or two letters that look alike.
ODD, NEAR, FAR = 1, 2, 3

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Beyond these code points no character has case.
_CASED = 0x1E944


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x.astype(np.uint64) + np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _classes() -> dict[str, str]:
    """Each letter that can be confused to the first of those it is linked with, by any number of steps."""
    first = {c: c for p in CONFUSED for c in p}
    for a, b in CONFUSED:
        one, other = sorted((first[a], first[b]))
        first = {c: one if f == other else f for c, f in first.items()}
    return first


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point the lower-case one and its class, whether two letters look alike, whether one can be lost."""
    lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(_CASED)], np.uint32)
    kind = np.arange(_CASED, dtype=np.uint32)
    for c, f in _classes().items():
        kind[ord(c)] = ord(f)
    alike, lost = np.zeros((128, 128), bool), np.zeros(128, bool)
    for a, b in CONFUSED:
        alike[ord(a), ord(b)] = alike[ord(b), ord(a)] = True
    lost[[ord(c) for c in LOST]] = True
    return lower, kind[lower], alike, lost


def _by(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.where(points < _CASED, table[np.minimum(points, _CASED - 1)], points)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points, and where each word begins."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(np.array([len(w) for w in words], np.int64))]).astype(np.int64)


def _blocks(sizes: list[int]) -> list[slice]:
    """Ranges of about CHARACTERS characters."""
    block = np.cumsum(np.array(sizes, np.int64)) // CHARACTERS
    ends = [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    return [slice(i, j) for i, j in zip([0, *ends], ends)]


def _places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, place in it) of all characters, in order."""
    word = np.repeat(np.arange(len(size)), size)
    return word, np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, where each word's begin).  Two words share a key if they are one edit or swap apart, or differ in two letters that look alike.

    Of the first kind: the word and all that lack one of its letters, of long ones an intact beginning or end.
    Of the second: the classes of its letters with two intact quarters.
    """
    flat, at = _points(words)
    n = np.diff(at)
    q, place = _places(n)
    power, inverse = _powers(_BASE, int(n.max(initial=0))), _powers(_INVERSE, int(n.max(initial=0)))
    sums = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(x) * power[place])])
    whole, classes = sums(flat), sums(_by(_tables()[1], flat))
    total = whole[at[1:]] - whole[at[:-1]]
    short, long = n <= LONG + 1, n >= LONG
    # Without either letter of two in a row that are equal a word is the same.
    kept = short[q] & np.append(flat[1:] != flat[:-1], True)[: len(flat)]
    kept[at[1:][n > 0] - 1] = short[n > 0]
    f = np.flatnonzero(kept)
    lacking = np.bincount(q[f], minlength=len(n))
    first = np.concatenate([[0], np.cumsum(short + lacking + 4 * long + 6)]).astype(np.int64)
    out = np.zeros(first[-1], np.uint64)
    out[first[:-1][short]] = total[short]
    rank = np.arange(len(f)) - np.repeat(np.cumsum(lacking) - lacking, lacking)
    out[first[q[f]] + 1 + rank] = whole[f] - whole[at[q[f]]] + np.uint64(_INVERSE) * (whole[at[q[f] + 1]] - whole[f + 1])
    i = np.flatnonzero(long)
    for k, m in enumerate((n[i] - 1, n[i])):
        p = m // 2 - 1
        out[first[i + 1] - 10 + 2 * k] = _mixed(whole[at[i] + p] - whole[at[i]] + np.uint64(1))
        out[first[i + 1] - 9 + 2 * k] = _mixed((whole[at[i + 1]] - whole[at[i + 1] - p]) * inverse[n[i] - p] + np.uint64(2))
    part = [whole[at[:-1] + n * (k + 1) // 4] - whole[at[:-1] + n * k // 4] for k in range(4)]
    kinds = _mixed(classes[at[1:]] - classes[at[:-1]])
    for t, (j, k) in enumerate(combinations(range(4), 2)):
        out[first[1:] - 6 + t] = _mixed(_mixed(kinds + part[j] + np.uint64(t)) + part[k])
    return out.view(np.int64), first


def differences(a: list[str], b: list[str]) -> np.ndarray:
    """Of each pair of words ODD, NEAR or FAR, or 0 if they are equal or further apart."""
    lower, _, alike, lost = _tables()
    (x, x_at), (y, y_at) = _points(a), _points(b)
    m, n = np.diff(x_at), np.diff(y_at)
    out = np.zeros(len(a), np.int8)

    def looks(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Whether letters look alike, and whether they are the same but for case."""
        c, d = _by(lower, c), _by(lower, d)
        return np.where((c < 128) & (d < 128), alike[np.minimum(c, 127), np.minimum(d, 127)], False), c == d

    same = np.flatnonzero(m == n)
    q, place = _places(m[same])
    c, d = x[x_at[same][q] + place], y[y_at[same][q] + place]
    at = np.flatnonzero(c != d)
    count = np.bincount(q[at], minlength=len(same))
    begin = np.cumsum(count) - count
    one, two = np.flatnonzero(count == 1), np.flatnonzero(count == 2)
    i = at[begin[one]]
    out[same[one]] = np.where(looks(c[i], d[i])[0], NEAR, ODD)
    i, j = at[begin[two]], at[begin[two] + 1] if len(two) else at[:0]
    (like_i, case_i), (like_j, case_j) = looks(c[i], d[i]), looks(c[j], d[j])
    good = (like_i | case_i) & (like_j | case_j) & ~(case_i & case_j)
    swapped = (place[j] == place[i] + 1) & (c[i] == d[j]) & (c[j] == d[i])
    out[same[two]] = np.where(swapped, np.where(good, NEAR, ODD), np.where(good, FAR, 0))

    # The longer word's letter where they first differ is left out, and the rest is compared.
    flat, y_from = np.concatenate([x, y]), y_at[:-1] + len(x)
    more = np.flatnonzero(np.abs(m - n) == 1)
    shorter, longer = np.where(m < n, x_at[:-1], y_from)[more], np.where(m < n, y_from, x_at[:-1])[more]
    size = np.minimum(m, n)[more]
    q, place = _places(size)
    c = flat[shorter[q] + place]
    split, last = size.copy(), np.full(len(more), -1)
    at = np.flatnonzero(c != flat[longer[q] + place])[::-1]
    split[q[at]] = place[at]
    at = np.flatnonzero(c != flat[longer[q] + place + 1])
    last[q[at]] = place[at]
    gone = _by(lower, flat[longer + split])
    out[more] = np.where(last < split, np.where((gone < 128) & lost[np.minimum(gone, 127)], NEAR, ODD), 0)
    return out


@cache
def keys():
    """UDF: the hashes of a word."""

    @F.arrow_udf("array<long>")
    def run(w: pa.Array) -> pa.Array:
        words = w.fill_null("").to_pylist()
        parts = [hashes(words[b]) for b in _blocks([len(x) for x in words])]
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in parts]))])
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate([k for k, _ in parts])), mask=w.is_null())

    return run


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (wrong, word, ...) that are near, with what they differ in."""
    for b in batches:
        wrong, word = b.column("wrong").to_pylist(), b.column("word").to_pylist()
        how = np.concatenate([differences(wrong[i], word[i]) for i in _blocks([len(x) + len(y) for x, y in zip(wrong, word)])])
        near = np.flatnonzero(how)
        kept = b.take(pa.array(near))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(how[near])], names=[*b.schema.names, "how"])
