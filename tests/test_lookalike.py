"""Hashes that near words share, and what pairs of words differ in, against plain Python."""

import random
import re

import pytest

from quillspark.functions import lookalike
from quillspark.operators import spelling


def difference(a, b):
    pairs, low = {frozenset(p) for p in lookalike.CONFUSED}, (a.lower(), b.lower())
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        other = [frozenset(p) for p in zip(*low) if p[0] != p[1]]
        good = 1 <= len(other) <= 2 and all(p in pairs for p in other)
        swapped = len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]
        if len(at) == 1 or swapped:
            return lookalike.NEAR if good else lookalike.ODD
        return lookalike.FAR if len(at) == 2 and good else 0
    s, l = sorted((a, b), key=len)
    if len(l) - len(s) != 1 or all(l[:i] + l[i + 1 :] != s for i in range(len(l))):
        return 0
    s, l = sorted(low, key=len)
    gone = next(l[i] for i in range(len(l)) if l[:i] + l[i + 1 :] == s)
    return lookalike.NEAR if re.match("^[a-jl-rt-wy]$", gone) else lookalike.ODD


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("aceonhHküé\U0001f600s\0") for _ in range(n))
    out = []
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 17, 30, 31, 32, 33, 34, 35, 50] * 60:
        a = letters(n)
        b = list(a)
        for _ in range(rng.randrange(4)):
            kind, i = rng.randrange(5), rng.randrange(len(b) + 1)
            if kind == 0:
                b.insert(i, letters(1))
            elif i < len(b) and kind == 1:
                del b[i]
            elif i + 1 < len(b) and kind == 2:
                b[i], b[i + 1] = b[i + 1], b[i]
            elif i < len(b):
                b[i] = rng.choice([*{"a": "ceo", "c": "aeo", "e": "aco", "o": "ace", "n": "h", "h": "n"}.get(b[i], "x"), letters(1)])
        out.append((a, "".join(b)))
    return out


def test_differences(pairs):
    found = lookalike.differences([a for a, _ in pairs], [b for _, b in pairs]).tolist()
    assert found == [difference(a, b) for a, b in pairs] and set(found) == {0, 1, 2, 3}


def test_near_words_share_a_key(pairs):
    of = []
    for words in zip(*pairs):
        keys, first = lookalike.hashes(list(words))
        of.append([set(keys[i:j].tolist()) for i, j in zip(first, first[1:])])
        assert [lookalike.hashes([w])[0].tolist() for w in words] == [keys[i:j].tolist() for i, j in zip(first, first[1:])]
    assert not [p for p, x, y in zip(pairs, *of) if difference(*p) and not x & y]


def test_few_keys():
    """Two masked letters of 12 were 66 keys."""
    assert len(lookalike.hashes(["abcdefghijkl"])[0]) == 12 + 1 + 6 and len(lookalike.hashes(["abcdefghij" * 100])[0]) == 4 + 6


def test_blocks_change_nothing(spark, monkeypatch):
    words = ["", "hello", None, "abc" * 20, "world"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").coalesce(1)
    got = dict(df.select("i", lookalike.keys()("w")).collect())
    assert got[2] is None and {i: got[i] for i in (0, 1, 3, 4)} == {i: lookalike.hashes([words[i]])[0].tolist() for i in (0, 1, 3, 4)}
    monkeypatch.setattr(lookalike, "CHARACTERS", 6)
    cut = lookalike._blocks([0, 5, 0, 60, 5, 1])
    assert [i for b in cut for i in range(b.start, b.stop)] == list(range(6)) and len(cut) > 2 and lookalike._blocks([]) == [slice(0, 0)]


def test_texts_are_read_once(spark, sf):
    """The words of all texts are counted once; each further use of them split every text again."""
    from quillspark.plans.queries import QUERIES

    plan = QUERIES["step12_spelling"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    assert {r.word for r in spelling.vocabulary_of(spark.createDataFrame([("Ab, ab 1 c\n",), ("",), (None,), (" c",)], "text string")).collect()} == {"ab", "c"}
