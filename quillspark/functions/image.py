"""Image measures as Arrow-batched UDFs over grey pixels (height, width, data); decisions on them are plain Columns."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE_GATE = 0.8


def grey(height: int, width: int, data: bytes) -> np.ndarray:
    """Pixels as a grey matrix; three channels (blue, green, red) are weighted."""
    a = np.frombuffer(data, np.uint8).astype(np.float64)
    if a.size == height * width * 3:
        a = a.reshape(height, width, 3)
        return 0.114 * a[..., 0] + 0.587 * a[..., 1] + 0.299 * a[..., 2]
    return a.reshape(height, width)


#: Kernel widths of lines, at least and as a share of the side: for forms and for headers; the shares of a page's regions.
FORM_KERNEL, HEADER_KERNEL = (20, 25), (25, 20)
SIGNATURE_FROM, HEADER_TO, MOST_COLUMNS = 0.80, 0.15, 1000


def narrowed(g: np.ndarray, most: int = MOST_COLUMNS) -> np.ndarray:
    """g scaled to at most so many columns, bilinear between pixel centres."""
    if g.shape[1] <= most:
        return g
    scale = most / g.shape[1]
    size = [int(n * scale + 0.5) for n in g.shape]
    for axis, n in enumerate(size):
        at = np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, g.shape[axis] - 1)
        low = np.floor(at).astype(int)
        high, share = np.minimum(low + 1, g.shape[axis] - 1), at - low
        share = share[:, None] if axis == 0 else share
        g = np.take(g, low, axis) * (1 - share) + np.take(g, high, axis) * share
    return np.floor(g + 0.5)


def regions(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, signature region, header) of a page."""
    cut = int(g.shape[0] * SIGNATURE_FROM)
    return g[:cut], g[cut:], g[: int(g.shape[0] * HEADER_TO)]


def ink(g: np.ndarray) -> np.ndarray:
    """Which pixels are no lighter than Otsu's threshold."""
    counts = np.bincount(g.astype(np.uint8).ravel(), minlength=256).astype(np.float64)
    w0, m0 = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m0[-1] * w0 / w0[-1] - m0) ** 2 / (w0 * (w0[-1] - w0))
    return g <= int(np.argmax(np.where(np.isfinite(between), between, -1)))


def line_pixels(dark: np.ndarray, least: int) -> int:
    """Pixels in horizontal runs of at least so many: what an opening by a row of that width leaves."""
    wide = np.zeros((dark.shape[0], dark.shape[1] + 2), np.int8)
    wide[:, 1:-1] = dark
    edge = np.diff(wide, axis=1)
    runs = np.nonzero(edge == -1)[1] - np.nonzero(edge == 1)[1]
    return int(runs[runs >= least].sum())


def edge_pixels(g: np.ndarray, low: float = 50, high: float = 150) -> int:
    """Canny's edges: Sobel gradients, maxima along their direction, hysteresis."""
    p = np.pad(g.astype(np.float64), 1, mode="edge")
    a, b, c = p[:-2], p[1:-1], p[2:]
    dx = (a[:, 2:] - a[:, :-2]) + 2 * (b[:, 2:] - b[:, :-2]) + (c[:, 2:] - c[:, :-2])
    dy = (c[:, :-2] + 2 * c[:, 1:-1] + c[:, 2:]) - (a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:])
    m = np.pad(np.abs(dx) + np.abs(dy), 1)
    at = lambda y, x: m[1 + y : m.shape[0] - 1 + y, 1 + x : m.shape[1] - 1 + x]
    here, flat = at(0, 0), np.abs(dy) < np.abs(dx) * 0.4142135623730951
    steep, same = np.abs(dy) > np.abs(dx) * 2.414213562373095, (dx < 0) == (dy < 0)
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    peak = np.where(flat | steep, (here > before) & (here >= after), (here > before) & (here > after)) & (here > low)
    found, new = np.zeros_like(m, bool), np.pad(peak & (here > high), 1)
    weak = np.pad(peak, 1)
    while new.any():
        found |= new
        near = np.zeros_like(found)
        ys, xs = np.nonzero(new)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                near[ys + i, xs + j] = True
        new = near & weak & ~found
    return int(np.count_nonzero(found))


def stroke_widths(dark: np.ndarray) -> np.ndarray:
    """Distance of each ink pixel from the ground, by a chamfer of 1, 1.4 and 2.1969 on 5 by 5 neighbours."""
    far = 1e9
    d = np.pad(np.where(dark, far, 0.0), 2, constant_values=far)
    steps = ((-1, -2, 2.1969), (-1, -1, 1.4), (-1, 0, 1.0), (-1, 1, 1.4), (-1, 2, 2.1969), (-2, -1, 2.1969), (-2, 1, 2.1969))
    column = np.arange(dark.shape[1])
    # Rows without ink stay 0.
    inked = np.flatnonzero(dark.any(axis=1)) + 2
    for turn in (False, True):
        d = d[::-1, ::-1] if turn else d
        for y in (d.shape[0] - 1 - inked[::-1] if turn else inked).tolist():
            best = np.min([d[y + i, 2 + j : d.shape[1] - 2 + j] + w for i, j, w in steps] + [d[y, 2:-2]], axis=0)
            d[y, 2:-2] = np.minimum.accumulate(best - column) + column
        d = d[::-1, ::-1] if turn else d
    inner = d[2:-2, 2:-2]
    return inner[dark & (inner < far / 2)]


def page_measures(g: np.ndarray) -> dict:
    """What the page's class is decided on: edges, ruled lines, component sizes and strokes of the analysed region, ink and lines of the others."""
    g = narrowed(g)
    body, foot, head = regions(g)
    out: dict = {"pixels": int(g.size), "foot_height": foot.shape[0], "head_height": head.shape[0], "width": g.shape[1], "foot_pixels": int(foot.size)}
    dark = ink(g)
    out["horizontal"] = line_pixels(dark, max(FORM_KERNEL[0], g.shape[1] // FORM_KERNEL[1]))
    out["vertical"] = line_pixels(dark.T, max(FORM_KERNEL[0], g.shape[0] // FORM_KERNEL[1]))
    two = lambda x: x.size > 0 and x.min() < x.max()
    out["foot_ink"] = float(ink(foot).mean()) if two(foot) else 0.0
    out["foot_parts"] = [{"area": a, "width": w, "height": h} for a, w, h in ink_components(foot)] if two(foot) else []
    out["head_ink"] = float(ink(head).mean()) if two(head) else 0.0
    out["head_lines"] = line_pixels(ink(head), max(HEADER_KERNEL[0], g.shape[1] // HEADER_KERNEL[1])) if two(head) else 0
    for name, part in (("body", body), ("page", g)):
        widths = stroke_widths(ink(part)) if two(part) else np.zeros(0)
        out[name] = {"edges": edge_pixels(part) / max(1, part.size), "strokes": len(widths), "stroke_mean": float(widths.mean()) if len(widths) else 0.0, "stroke_deviation": float(widths.std()) if len(widths) else 0.0}
    return out


_PART = "struct<edges:double,strokes:int,stroke_mean:double,stroke_deviation:double>"
MEASURES = f"struct<pixels:int,width:int,horizontal:int,vertical:int,foot_height:int,foot_pixels:int,foot_ink:double,foot_parts:array<struct<area:int,width:int,height:int>>,head_height:int,head_ink:double,head_lines:int,body:{_PART},page:{_PART}>"


def noise_of(g: np.ndarray) -> float:
    """Mean difference from the median of each pixel's surroundings, after thinning to 1000 columns at most."""
    step = max(1, -(-g.shape[1] // 1000))
    g = g[::step, ::step]
    p = np.pad(g, 1, mode="edge")
    around = np.stack([p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)])
    return float(np.abs(g - np.median(around, axis=0)).mean())


def median_filtered(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="edge")
    return np.median(np.stack([p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)]), axis=0)


def crop(g: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    x1, y1, x2, y2 = (int(v) for v in box)
    return g[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]


def ink_components(g: np.ndarray) -> list[tuple[int, int, int]]:
    """(area, width, height) of each 8-connected part darker than Otsu's threshold, by merging runs of rows."""
    dark = ink(g)
    parent: list[int] = []
    boxes: list[list[int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y in range(dark.shape[0]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], dark[y].astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            i = len(parent)
            parent.append(i)
            boxes.append([b - a, a, b, y, y + 1])
            for c, d, j in above:
                if c <= b and a <= d:
                    r, s = find(j), find(i)
                    if r != s:
                        parent[s] = r
                        u, v = boxes[r], boxes[s]
                        boxes[r] = [u[0] + v[0], min(u[1], v[1]), max(u[2], v[2]), min(u[3], v[3]), max(u[4], v[4])]
            here.append((a, b, i))
        above = here
    return [(boxes[i][0], boxes[i][2] - boxes[i][1], boxes[i][4] - boxes[i][3]) for i in range(len(parent)) if find(i) == i]


@cache
def noise():
    """UDF: noise of an image, null where it can't be read."""

    @F.pandas_udf("double")
    def run(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
        def one(h, w, d):
            try:
                return noise_of(grey(int(h), int(w), d))
            except (ValueError, TypeError):
                return None

        return pd.Series([one(*x) for x in zip(height, width, data)], dtype="float64")

    return run


@cache
def components():
    """UDF: array of (area, width, height) of the ink's connected parts, null where the image can't be read."""

    @F.pandas_udf("array<struct<area:int,width:int,height:int>>")
    def run(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
        def one(h, w, d):
            try:
                return [{"area": a, "width": b, "height": c} for a, b, c in ink_components(grey(int(h), int(w), d))]
            except (ValueError, TypeError):
                return None

        return pd.Series([one(*x) for x in zip(height, width, data)], dtype=object)

    return run


@cache
def measures():
    """UDF: `page_measures` of an image, null where it can't be read."""

    @F.pandas_udf(MEASURES)
    def run(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.DataFrame:
        def one(h, w, d):
            try:
                return page_measures(grey(int(h), int(w), d))
            except (ValueError, TypeError):
                return None

        names = [f.split(":")[0] for f in ("pixels width horizontal vertical foot_height foot_pixels foot_ink foot_parts head_height head_ink head_lines body page").split()]
        rows = [one(*x) or dict.fromkeys(names) for x in zip(height, width, data)]
        return pd.DataFrame(rows, columns=names)

    return run


def needs_denoising(value: Column) -> Column:
    return F.coalesce(value >= NOISE_GATE, F.lit(False))
