"""Near duplicates and decontamination against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from made_texts import prose

from quillspark.llm import _vec, decontaminate, near_dup

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def word_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components_by_force(rows, k, percent):
    """Smallest non-null id reachable, by row."""
    sets = [word_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            parent[find(b)] = find(a)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in low[find(i)] if x is not None]
        out.append((d, len(sets[i]), (min(known) if known else None) if sets[i] else d))
    return out, len({find(i) for i in range(len(rows)) if sets[i]})


def edited(text, share, seed):
    rng = random.Random(seed)
    w = text.split(" ")
    for i in rng.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "percent", "bounds"), [(3, 85, {}), (5, 80, {"block_rows": 6}), (3, 85, {"block_bytes": 8000, "broadcast_ids": 0})])
def test_components_equal_brute_force(spark, k, percent, bounds):
    rows = [(i, prose(60 + i % 40, i)) for i in range(60)]
    # A chain of slow drift, near copies about the threshold, exact copies, short and blank texts.
    text = prose(200, 999)
    for j in range(25):
        text = edited(text, 0.02, j)
        rows.append((100 + j, text))
    for j in range(30):
        rows.append((200 + j, edited(rows[j][1], 0.015 * (1 + j % 3), j)))
    # Copies of one text, of which many resemble it and not each other, some two and two.
    for j in range(40):
        rows.append((500 + j, edited(rows[3][1], 0.02 + 0.002 * (j % 12), 7000 + j // 2)))
    rows += [(300 + j, rows[0][1].upper()) for j in range(40)]
    rows += [(400, "a b"), (401, "A  b"), (402, ""), (403, None), (404, " \n"), (5, rows[9][1]), (None, rows[9][1]), (None, "lonely words of no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    params = near_dup.NearDupParams(shingle=k, percent=percent, **bounds)
    got = sorted(((r.doc_id, r.n, r.component_id) for r in near_dup.classes(df, params).collect()), key=str)
    want, groups = components_by_force(rows, k, percent)
    assert got == sorted(want, key=str)
    kept = near_dup.deduplicate(df, params)
    assert kept.where("trim(text) not in ('', '\n')").count() == groups


def test_overlaps_equal_set_intersections():
    rng = random.Random(4)
    sets = [set(rng.sample(range(300), rng.randrange(1, 120))) | {1000 + i // 3} for i in range(45)]
    got = near_dup.overlaps([np.array(sorted(s), np.uint64) for s in sets], width=64)
    assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(45) for j in range(45) if i != j)


def test_columns_of_any_name_are_kept(spark):
    text = prose(60, 8)
    rows = [(1, text, *"abcdefgh"), (2, text, *"ABCDEFGH"), (3, "", *"ijklmnop")]
    names = ["_n", "_G1", "_d", "f1", "d", "k1", "again", "n"]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = near_dup.deduplicate(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_densified_signatures_estimate_resemblance():
    params = near_dup.NearDupParams()
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 2**63, 40, dtype=np.uint64))
    other = np.sort(np.concatenate([base[:30], rng.integers(0, 2**63, 10, dtype=np.uint64)]))
    s = near_dup.signatures(np.concatenate([base * np.uint64(2), other * np.uint64(2)]), np.array([0, 40, 80]), params)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.2
    one = near_dup.signatures(np.array([5], np.uint64), np.array([0, 1, 1]), params)
    assert (one[0] == 5).all()


def test_near_dup_edge_cases(hard_docs, empty_docs):
    kept = near_dup.deduplicate(hard_docs)
    assert kept.columns == hard_docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert got == sorted([1, 3, 4, 5, None, 6, 7, 8], key=str)
    assert near_dup.classes(empty_docs).count() == 0 and near_dup.deduplicate(empty_docs).count() == 0


def test_all_rows_equal(spark):
    df = spark.createDataFrame([(9, prose(40, 4))] * 50, "doc_id long, text string")
    assert near_dup.deduplicate(df).count() == 1
    assert {r.component_id for r in near_dup.classes(df).collect()} == {9}


def test_words_and_grams_equal_plain_code():
    texts = ["", None, "A b", " x\x0by ", "one two three four", "w" * 3000 + " tail", "é ü"]
    data, offsets = _vec.buffers(pa.array(texts))
    w = _vec.Words(data, offsets)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert w.counts.tolist() == [len(p) for p in plain]
    flat = [x.translate(ASCII_LOWER) for p in plain for x in p]
    h = w.hashes()
    assert [h[i] == h[j] for i, j in itertools.combinations(range(len(flat)), 2)] == [flat[i] == flat[j] for i, j in itertools.combinations(range(len(flat)), 2)]
    assert len(_vec.grams(h, w.first, 3)[0]) == 2


def align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_smith_waterman_equals_plain_table():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(2, 8, int(rng.integers(1, 30))).astype(np.uint64), rng.integers(2, 8, int(rng.integers(1, 50))).astype(np.uint64)) for _ in range(150)]
    assert decontaminate.smith_waterman(pairs)[:, 0].tolist() == [align(a.tolist(), b.tolist()) for a, b in pairs]


def test_copies_are_found_and_clean_texts_left(spark, empty_docs):
    items = [(i, prose(40, 5000 + i)) for i in range(12)] + [(50, "two words"), (51, None), (52, "")]
    rows = []
    for i in range(12):
        rows.append((i, prose(150, i) + "\n" + items[i][1].upper().replace(" ", ", ") + " " + prose(50, 70 + i)))
        rows.append((100 + i, prose(150, 300 + i) + " " + edited(items[i][1], 0.15, i) + " " + prose(50, 370 + i)))
        rows.append((200 + i, prose(300, 600 + i)))
    rows += [(300, None), (301, ""), (302, items[3][1]), (302, items[3][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect())
    want = collections.Counter([(i, i) for i in range(12)] + [(100 + i, i) for i in range(12)] + [(302, 3)] * 2)
    assert found == want
    kept = decontaminate.clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([200 + i for i in range(12)] + [300, 301])
    small = decontaminate.DecontaminateParams(block_grams=100)
    assert collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find(docs, bench, small).collect()) == want
    assert decontaminate.find(empty_docs, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def found_by_alignment(docs, items, least=0.5):
    """All pairs aligned by the plain table over letters-and-digits words."""
    split = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").translate(ASCII_LOWER))
    return collections.Counter((d, i) for d, t in docs for i, u in items if split(u) and align(split(u), split(t)) >= least * len(split(u)))


@pytest.mark.parametrize("copies", [9, 60])
def test_many_edited_copies_are_all_found(spark, copies):
    items = [(1, prose(40, 71)), (2, prose(24, 72))]
    docs = [(k, f"{prose(20, 800 + k)} {edited(items[k % 2][1], 0.18, k)} {prose(20, 900 + k)}") for k in range(copies)]
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = found_by_alignment(docs, items)
    assert got == want and sum(want.values()) == copies


def test_one_surviving_seed_suffices(spark):
    words = prose(18, 73).split(" ")
    loose = words[:3] + ["first"] + [x for k, w in enumerate(words[3:]) for x in ([w, f"ins{k}"] if k % 2 else [w])]
    items = [(1, " ".join(words)), (2, "red green blue pink teal")]
    docs = [(1, " ".join(loose)), (2, "red green blue other words here")]
    got = {(r.doc_id, r.item_id): r.seeds_hit for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): 1, (2, 2): 1} and set(got) == set(found_by_alignment(docs, items))


@pytest.mark.parametrize("bounds", [{}, {"rare_items": 0, "held_hits": 7, "piece_words": 64}])
def test_copies_at_every_rate_of_edits(spark, bounds):
    rng = random.Random(11)
    items = [(i, prose(15 + 3 * i, 4000 + i)) for i in range(10)]
    docs = []
    for k in range(240):
        w = items[k % 10][1].split(" ")
        out = []
        for x in w:
            act = rng.random()
            rate = (k // 10) / 60
            out += [] if act < rate / 3 else [x, f"x{rng.randrange(99)}"] if act < 2 * rate / 3 else [f"y{rng.randrange(99)}"] if act < rate else [x]
        docs.append((k, f"{prose(30, 10_000 + k)} {' '.join(out)} {prose(12, 20_000 + k)}"))
    docs.append((999, " ".join([items[2][1]] * 40)))
    params = decontaminate.DecontaminateParams(**bounds)
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), params).collect())
    want = found_by_alignment(docs, items)
    assert not got - want and sum(got.values()) >= 0.99 * sum(want.values()) and sum(want.values()) > 100


def test_extra_columns_and_ties(spark):
    item = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(1, f"{item} xx yy zz {item}", 5, "p"), (2, "clean text of no item at all", 6, "q")], "doc_id long, text string, score int, item_id string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.find(docs, bench).select("doc_id", "item_id", "score", "word_end").collect()] == [(1, 7, 1.0, 6)]
    assert [tuple(r) for r in decontaminate.clean(docs, bench).collect()] == [(2, "clean text of no item at all", 6, "q")]
