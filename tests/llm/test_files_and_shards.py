"""Sharding, mixing and archives: exact laws and round trips."""

import collections
import hashlib
import io
import zlib

import pytest
from made_texts import prose
from pyspark.sql import functions as F

from quillspark.llm import mixing, sharding, warc


def check_shards(rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_are_even_whole_and_shuffled(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    params = sharding.ShardParams(shards=7, bucket_bytes=4000)
    rows = sharding.assign(df, params).collect()
    check_shards(rows, 7)
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot * 7 + r.shard)]
    assert sum(a < b for a, b in zip(order, order[1:])) in range(1350, 1650)
    again = sharding.assign(df, params).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == {r.doc_id: (r.shard, r.slot) for r in again}


def test_hot_rows_are_spread(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    params = sharding.ShardParams(shards=4, hot_rows=100)
    spread = sharding.scatter(df, params, 16).groupBy("_b").count().collect()
    assert len(spread) == 16 and max(r["count"] for r in spread) < 400
    check_shards(sharding.assign(df, params).collect(), 4)


def test_sharding_edge_cases(hard_docs, empty_docs, tmp_path):
    rows = sharding.assign(hard_docs, sharding.ShardParams(shards=3)).collect()
    assert len(rows) == 10
    check_shards(rows, 3)
    assert sharding.assign(empty_docs).count() == 0
    sharding.write_shards(hard_docs, f"file://{tmp_path}/out", sharding.ShardParams(shards=3))
    assert hard_docs.sparkSession.read.parquet(f"file://{tmp_path}/out").count() == 10


CLASHING = ["_p", "_hot", "_k", "_b", "hot", "_before", "_key", "_no", "_total", "_order", "_text_key", "_size", "_c", "_row", "_rest", "_shards", "_range", "_copies"]


def test_columns_of_any_name_are_kept(spark):
    rows = [(i, prose(9 + i, i), "ab"[i % 2], *range(100 * i, 100 * i + len(CLASHING))) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *CLASHING])
    sharded = sharding.assign(df, sharding.ShardParams(shards=3))
    assert sharded.columns == [*df.columns, "shard", "slot"]
    assert sorted(tuple(r)[:-2] for r in sharded.collect()) == rows
    mixed = mixing.mix(df, mixing.MixParams(min_block_words=8))
    assert mixed.columns == [*df.columns, "mix_shard", "mix_copy"]
    whole = {r[0]: r for r in rows}
    got = mixed.collect()
    assert got and all(tuple(r)[2:-2] == whole[r.doc_id][2:] and whole[r.doc_id][1].startswith(r.text) for r in got)
    planned = mixing.plan(mixing.measured(df.drop("_size", "_copies", "_total", "_text_key")))
    assert all(r._key == whole[r.doc_id][3 + CLASHING.index("_key")] for r in planned.collect())


def test_large_copies_are_spread_by_bytes(spark):
    df = spark.range(60).select(F.lit(1).cast("long").alias("doc_id"), F.expr("repeat('long text ', 500)").alias("text"))
    params = sharding.ShardParams(shards=4, bucket_bytes=20_000)
    assert sharding.scatter(df, params, 16).groupBy("_b").count().count() > 8
    check_shards(sharding.assign(df, params).collect(), 4)


def test_offsets_over_groups_of_buckets(spark):
    df = spark.range(500).select((F.col("id") * F.col("id") % 37).cast("int").alias("_b"))
    got = {r._b: r._before for r in sharding.offsets(df, group=5).collect()}
    of = collections.Counter(r._b for r in df.collect())
    assert got == {b: sum(n for k, n in of.items() if k < b) for b in of}


def plain_targets(totals, weights=(5, 2, 1), repeats=3):
    """Water filling by rounds."""
    w = [weights[i % len(weights)] for i in range(len(totals))]
    whole, target, open_ = sum(totals), [0.0] * len(totals), set(range(len(totals)))
    left = float(whole)
    while open_:
        share = left / sum(w[i] for i in open_)
        full = {i for i in open_ if share * w[i] > repeats * totals[i]}
        if not full:
            for i in open_:
                target[i] = share * w[i]
            break
        for i in full:
            target[i] = float(repeats * totals[i])
            left -= target[i]
        open_ -= full
    return target


def test_mixing_meets_targets(spark):
    sizes = {"a": 40, "b": 400, "é": 30, None: 90, "zz": 3}
    rows = [(i, prose(5 + i % 50, i), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    params = mixing.MixParams(min_block_words=64, shards=5)
    got = mixing.plan(mixing.measured(df), params).collect()
    order = ["a", "b", "zz", "é", None]
    total = collections.Counter()
    for r in got:
        total[r.source] += r._size
    want = dict(zip(order, plain_targets([total[s] for s in order])))
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r._taken
        assert abs(r._target - want[r.source]) < 1e-6 * max(1, r._target) and 0 <= r._taken <= 3 * r._size
        assert all(0 <= c.shard < 5 for c in r._copies)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in order)
    again = mixing.plan(mixing.measured(df), params).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(df, params)
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(taken.values())
    assert not any(x in mixed._jdf.queryExecution().toString() for x in ("Python", "Pandas", "MapInArrow"))


def test_tree_splits_quotas_exactly(spark):
    quotas = spark.createDataFrame([(i, 10 * (i + 1)) for i in range(6)], "_no long, _quota long")
    leaves = mixing.splitting_tree(quotas, mixing.MixParams(shards=8)).collect()
    assert len(leaves) == 210 and len({(r._no, r._ticket) for r in leaves}) == 210
    by = collections.Counter(r._shard for r in leaves)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 3


def test_mixing_edge_cases(hard_docs, empty_docs):
    mixed = mixing.mix(hard_docs)
    assert set(hard_docs.columns) <= set(mixed.columns) and mixed.count() > 0
    assert mixing.mix(empty_docs).count() == 0
    assert mixing.plan(mixing.measured(hard_docs)).count() == 10


PAGES = [
    (1, "http://a/1", "<p>" + "x" * 50_000),
    (2, "http://a/2", "<p>" + "x" * 50_000),
    (3, None, None),
    (4, "http://a/4\r\nbad: header", ""),
    (5, "u", "é" * 5000),
    (5, "u", "é" * 5000),
    (None, "v", "no id"),
    (7, "w", "<p>WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n0\r\n\r\n"),
]


@pytest.mark.parametrize("params", [warc.WarcParams(keep_payload=True), warc.WarcParams(keep_payload=True, chunk_bytes=100, segment_bytes=777, archive_bytes=2000)])
def test_archives_round_trip(spark, params):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    rows = warc.read(warc.write(df, params), params).collect()
    assert len(rows) == len(PAGES) and {r.status for r in rows} == {"complete"}
    text = collections.Counter((i, (h or "").encode()) for i, _, h in PAGES)
    first = {}
    for i, h in text:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    for r in rows:
        payload = next(h for i, h in text if i == r.page_id and warc.digest_of(h) == r.payload_digest)
        response = r.page_id is None or first[payload] == r.page_id
        assert r.record_type == ("response" if response else "revisit") and r.refers_to == (None if response else first[payload])
        assert r.payload_bytes == len(payload) and (not response or bytes(r.payload) == payload)


def test_broken_archives_are_told_apart(spark, tmp_path):
    params = warc.WarcParams(chunk_bytes=100, segment_bytes=500)
    records = [list(warc.records_of(i, "u", (f"{i}" * 2000).encode(), None, i, params)) for i in range(5)]
    del records[1][2]
    records[2][-1] = records[2][-1].replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 9")
    records[3][1] = records[3][1].replace(b"\r\n64\r\n", b"\r\nzz\r\n", 1)
    body = b"".join(zlib.compress(r, wbits=31) for part in reversed(records) for r in part)
    (tmp_path / "a.warc.gz").write_bytes(body[:-40])
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", 0, 0)], warc.MANIFEST)
    got = {r.page_id: r.status for r in warc.read(manifest, params).collect()}
    assert got[1] == "missing_segment" and got[2] == "wrong_length" and got[3] == "bad_framing" and got[4] == "complete"


def test_archives_of_any_bytes_get_a_status(spark, tmp_path):
    params = warc.WarcParams()
    good = next(warc.records_of(7, "http://u", b"payload", None, 0, params))
    press = lambda r: zlib.compress(r, wbits=31)
    foreign = press(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n")
    request = press(b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n")
    files = {
        "length": press(good.replace(b"Content-Length: ", b"Content-Length: abc")),
        "plain": b"no gzip at all",
        "garbage": press(good) + b"\x00\xff" * 40,
        "segment": press(good.replace(b"WARC-Date", b"WARC-Segment-Number: x\r\nWARC-Date")),
        "foreign": request + foreign,
        "head": press(b"nothing of the kind\r\n\r\n"),
        "empty": b"",
    }
    got = {}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
        manifest = spark.createDataFrame([(f"file://{tmp_path}/{name}", 0, 0)], warc.MANIFEST)
        got[name] = sorted((r.status, r.page_id) for r in warc.read(manifest, params).collect())
    assert got == {"length": [("bad_header", 7)], "plain": [("bad_archive", None)], "garbage": [("bad_archive", None), ("complete", 7)], "segment": [("bad_header", 7)], "foreign": [("wrong_digest", None)], "head": [("bad_header", None)], "empty": []}


def test_records_use_standard_fields():
    first, again = next(warc.records_of(3, None, b"x", None, 5, warc.WarcParams())), next(warc.records_of(4, "u", b"x", 3, 6, warc.WarcParams(), 5))
    field = lambda r, name: next((x.partition(b": ")[2] for x in r.split(b"\r\n") if x.startswith(name + b": ")), None)
    assert field(again, b"WARC-Refers-To") == field(first, b"WARC-Record-ID") and field(first, b"WARC-Target-URI") is None
    assert all(field(r, b"WARC-Block-Digest") for r in (first, again)) and b"\r\nX-" not in first + again


def test_chunked_framing():
    for n in (0, 1, 99, 100, 101, 1000):
        data = hashlib.sha256(bytes([n % 256])).digest() * (n // 32 + 1)
        assert warc.unchunked(warc.chunked(data[:n], 100)) == data[:n]
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert list(warc.parse(io.BytesIO(b""))) == []


def test_warc_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(df)).count() == 0
