"""Bounding boxes as four DOUBLE columns; a box with a null corner is no box."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.config import DEFAULT, Config

Box = Sequence[Column]

#: Largest share of the page a detection of each label may cover.
AREA_LIMITS = dict(zip(("graphic", "logo", "signature", "human face"), (0.50, 0.30, 0.25, 0.10)))


def box(prefix: str = "", suffix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> tuple[Column, Column]:
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])


def overlap_of(a: Box, b: Box, reference: Box) -> Column:
    """Intersection over the reference's area; 0 where boxes are missing, only touch, or the reference has no area."""
    w, h = intersection(a, b)
    whole = area(a).isNotNull() & area(b).isNotNull()
    return F.when(whole & (w > 0) & (h > 0) & (area(reference) > 0), w * h / area(reference)).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    w, h = intersection(a, b)
    return F.when((w > 0) & (h > 0) & (area(a) > 0) & (area(b) > 0), w * h / F.least(area(a), area(b))).otherwise(F.lit(0.0))


def intersects(a: Box, b: Box) -> Column:
    return F.coalesce((a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1]), F.lit(False))


def page_size(b: Box, image_width: Column | None, image_height: Column | None, over, config: Config = DEFAULT) -> tuple[Column, Column]:
    """Width and height of each page: the largest corner or the image's size, US Letter points where neither is known."""

    def side(corner: Column, image: Column | None, default: float) -> Column:
        known = F.when(area(b).isNotNull(), corner)
        best = F.greatest(F.coalesce(F.max(known).over(over), F.lit(0.0)), F.lit(0.0) if image is None else F.coalesce(image, F.lit(0.0)), F.lit(0.0))
        return F.when(best == 0, F.lit(default)).otherwise(best)

    return side(b[2], image_width, config.default_width), side(b[3], image_height, config.default_height)


def padded(b: Box, padding: Column | int, width: Column, height: Column) -> list[Column]:
    """The box grown on every side, within the page; whole pixels."""
    p = F.lit(padding)
    zero = F.lit(0.0)
    return [F.greatest(zero, b[0] - p), F.greatest(zero, b[1] - p), F.least(width, b[2] + p), F.least(height, b[3] + p)]


def too_large(b: Box, width: Column, height: Column, label: Column) -> Column:
    """Whether a detection covers more of the page than its label allows; boxes without area always do."""
    w = F.least(width, b[2]) - F.greatest(F.lit(0.0), b[0])
    h = F.least(height, b[3]) - F.greatest(F.lit(0.0), b[1])
    limit = F.lit(0.50)
    for name, share in AREA_LIMITS.items():
        limit = F.when(F.lower(label) == name, F.lit(share)).otherwise(limit)
    return F.when((w <= 0) | (h <= 0), True).when(width * height == 0, False).otherwise(w * h / (width * height) > limit)


#: Words of a line placed before their boxes are put beside those of others.
WORDS_AT_ONCE = 64


def word_boxes(b: Box, words: Column, least_width: float = 10.0) -> Column:
    """array<struct<word,x1,x2>>: a line's width shared out by word lengths, half a character between words."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    length = lambda w: F.greatest(F.length(w), F.lit(1))
    units = F.aggregate(words, F.lit(0.0), lambda a, w: a + length(w).cast("double")) + (F.size(words) - 1) * F.lit(0.5)
    piece = F.struct(F.lit("").alias("word"), b[0].alias("x1"), b[0].alias("x2"))
    none = F.filter(F.array(piece), lambda s: F.lit(False))

    def placed(line: Column) -> Column:
        """Pieces in parts of a few words each, so that none is copied once a word."""
        unit = line["unit"]

        def add(acc: Column, word: Column) -> Column:
            start = F.when(acc["first"], b[0]).otherwise(acc["at"] + 0.5 * unit)
            end = lambda s: F.least(s + F.greatest(length(word) * unit, F.lit(least_width)), b[2])
            return let(start, lambda s: let(F.struct(s.alias("s"), end(s).alias("e")), lambda p: F.struct(p["e"].alias("at"), F.lit(False).alias("first"), F.concat(acc["done"], F.array(F.struct(word.alias("word"), p["s"].alias("x1"), p["e"].alias("x2")))).alias("done"))))

        def part(acc: Column, i: Column) -> Column:
            begun = F.struct(acc["at"].alias("at"), acc["first"].alias("first"), none.alias("done"))
            walked = F.aggregate(F.slice(line["words"], i * WORDS_AT_ONCE + 1, F.lit(WORDS_AT_ONCE)), begun, add)
            return let(walked, lambda w: F.struct(w["at"].alias("at"), w["first"].alias("first"), F.concat(acc["parts"], F.array(w["done"])).alias("parts")))

        parts = F.sequence(F.lit(0), F.floor((F.size(line["words"]) - 1) / WORDS_AT_ONCE).cast("int"))
        nothing = F.filter(F.array(none), lambda s: F.lit(False))
        return F.aggregate(parts, F.struct(b[0].alias("at"), F.lit(True).alias("first"), nothing.alias("parts")), part, lambda a: F.flatten(a["parts"]))

    folded = let(F.struct(words.alias("words"), ((b[2] - b[0]) / units).alias("unit")), placed)
    one = F.transform(words, lambda w: F.struct(w.alias("word"), b[0].alias("x1"), b[2].alias("x2")))
    return F.when(F.size(words) <= 1, one).otherwise(folded)
