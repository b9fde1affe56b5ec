"""Pixel measures against plain loops, and undecodable images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import classify, image
from quillspark.plans.queries import QUERIES
from quillspark.sources import documents


def drawn(seed, h=40, w=50):
    rng = np.random.default_rng(seed)
    g = np.full((h, w), 230.0)
    for _ in range(5):
        y, x = rng.integers(0, h - 8), rng.integers(0, w - 12)
        g[y : y + rng.integers(1, 8), x : x + rng.integers(1, 12)] = rng.integers(0, 120)
    return g


def plain_edges(g, low=50, high=150):
    h, w = g.shape
    px = lambda y, x: g[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    m, d = {}, {}
    for y in range(h):
        for x in range(w):
            dx = sum(c * (px(y + i, x + 1) - px(y + i, x - 1)) for i, c in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(c * (px(y + 1, x + j) - px(y - 1, x + j)) for j, c in ((-1, 1), (0, 2), (1, 1)))
            m[y, x], d[y, x] = abs(dx) + abs(dy), (dx, dy)
    peak = set()
    for (y, x), v in m.items():
        dx, dy = d[y, x]
        if v <= low:
            continue
        at = lambda i, j: m.get((y + i, x + j), 0)
        if abs(dy) < abs(dx) * 0.4142135623730951:
            ok = v > at(0, -1) and v >= at(0, 1)
        elif abs(dy) > abs(dx) * 2.414213562373095:
            ok = v > at(-1, 0) and v >= at(1, 0)
        else:
            s = 1 if (dx < 0) == (dy < 0) else -1
            ok = v > at(-1, -s) and v > at(1, s)
        if ok:
            peak.add((y, x))
    todo = [p for p in peak if m[p] > high]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if q in peak and q not in found:
                found.add(q)
                todo.append(q)
    return len(found)


@pytest.mark.parametrize("seed", range(6))
def test_edges_equal_plain_loops(seed):
    g = drawn(seed)
    assert image.edge_pixels(g) == plain_edges(g) > 0
    assert image.edge_pixels(np.full((9, 9), 7.0)) == 0


@pytest.mark.parametrize("seed", range(4))
def test_stroke_widths_equal_shortest_chamfer_paths(seed):
    dark = drawn(seed) < 200
    steps = [(i, j, w) for i in range(-2, 3) for j in range(-2, 3) for w in [{(0, 1): 1.0, (1, 1): 1.4, (1, 2): 2.1969}.get(tuple(sorted((abs(i), abs(j)))))] if w]
    d = np.where(dark, 1e9, 0.0)
    while True:
        new = d.copy()
        for y, x in zip(*np.nonzero(dark)):
            new[y, x] = min([d[y, x]] + [d[y + i, x + j] + w for i, j, w in steps if 0 <= y + i < d.shape[0] and 0 <= x + j < d.shape[1]])
        if (new == d).all():
            break
        d = new
    assert np.allclose(np.sort(image.stroke_widths(dark)), np.sort(d[dark]))


def test_lines_regions_and_widths():
    rng = np.random.default_rng(1)
    dark = rng.random((30, 60)) < 0.8
    opened = sum(len(run) for row in dark for run in "".join(".#"[int(v)] for v in row).split(".") if len(run) >= 5)
    assert image.line_pixels(dark, 5) == opened > 0
    g = drawn(2, 60, 2000)
    small = image.narrowed(g)
    assert small.shape == (30, 1000) and np.allclose(small, np.floor(g.reshape(30, 2, 1000, 2).mean((1, 3)) + 0.5), atol=1)
    assert image.narrowed(small) is small
    body, foot, head = image.regions(np.arange(100).reshape(100, 1))
    assert (len(body), foot[0, 0], len(head)) == (80, 80, 15)
    assert image.crop(g, (3, 2, 10, 6)).shape == (4, 7) and image.crop(g, (-5, -5, 2, 2)).shape == (2, 2)
    assert np.array_equal(image.median_filtered(np.full((4, 4), 3.0)), np.full((4, 4), 3.0))
    flat = np.full((20, 20), 9.0)
    assert image.noise_of(flat) == 0 and image.noise_of(flat + 90 * (rng.random((20, 20)) < 0.1)) > image.NOISE_GATE


def test_measures_decide_on_the_body_of_signed_pages(spark):
    g = np.full((300, 200), 255, np.uint8)
    g[20:24, 10:150] = 0
    g[270:276, 40:80] = 0
    blank = np.full((50, 60), 255, np.uint8)
    rows = [(1, 300, 200, bytearray(g.tobytes())), (2, 50, 60, bytearray(blank.tobytes())), (3, 9, 9, bytearray(b"short")), (4, None, None, None)]
    df = spark.createDataFrame(rows, "i int, height int, width int, data binary").select("i", image.measures()("height", "width", "data").alias("m"))
    f = classify.measured_flags(F.col("m"))
    got = {r.i: r for r in df.select("i", "m", *[c.alias(n) for n, c in f.items()]).collect()}
    assert got[1].has_signature and got[1].edge == got[1].m.body.edges > 0 and 0.6 < got[1].stroke < 0.7 and got[1].has_fax_header and got[1].form > 0
    assert not got[2].has_signature and (got[2].edge, got[2].form, got[2].stroke) == (0.0, 0.0, 0.5)
    assert got[3].m is None or got[3].m.pixels is None
    assert got[4].m is None or got[4].m.pixels is None


def test_images_that_cannot_be_decoded_are_told(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"not an image")
    r = documents.read_images(spark, str(tmp_path)).first()
    assert r.processing_error and r.data is None and r.height is None and r.origin.endswith("a.png")


def test_pages_are_dealt_to_tasks(spark, tmp_path):
    spark.range(600).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["c_pixels"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(got) == 3 and sum(r["count"] for r in got) == 600
