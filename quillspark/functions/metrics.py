"""Word and character error rates, strict and regardless of punctuation."""

from __future__ import annotations

from string import punctuation

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.distance import text_distance, word_distance
from quillspark.functions.text import words

PUNCTUATION = punctuation
#: Code points that stand for distinct words; below the surrogates.
FIRST_CODE, LAST_CODE = 0x4E00, 0xD7FF


def tokens(c: Column, flexible: bool = False) -> Column:
    low = F.lower(c)
    return words(F.translate(low, PUNCTUATION, " " * len(PUNCTUATION)) if flexible else low)


def characters(c: Column, flexible: bool = False) -> Column:
    """Lower case without blanks, and without punctuation if flexible; line breaks stay."""
    low = F.replace(F.lower(c), F.lit(" "), F.lit(""))
    return F.translate(low, PUNCTUATION, "") if flexible else low


def word_distance_native(a: Column, b: Column) -> Column:
    """Edit distance of two short word arrays inside the JVM: each distinct word becomes one character.

    Looking words up is linear in their number, so this is for lines; null for pairs of more than 35,328 distinct words.
    """
    vocabulary = F.array_distinct(F.concat(a, b))
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + (FIRST_CODE - 1)), 4, "0")), "UTF-16BE")
    text = lambda x: F.array_join(F.transform(x, code), "")
    return F.when(F.size(vocabulary) <= LAST_CODE - FIRST_CODE + 1, F.levenshtein(text(a), text(b)))


def edit_distance(a, b) -> int:
    """Edit distance of two sequences, a row of the table at a time."""
    codes: dict = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in s], np.int64) for s in (a, b))
    slope = np.arange(len(y) + 1)
    row = slope.copy()
    for i, v in enumerate(x):
        new = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != v))])
        row = np.minimum.accumulate(new - slope) + slope
    return int(row[-1])


def character_error_rate(reference: Column, hypothesis: Column, flexible: bool = False) -> Column:
    r = characters(reference, flexible)
    return F.coalesce(F.try_divide(text_distance()(r, characters(hypothesis, flexible)).cast("double"), F.length(r)), F.lit(0.0))


def evaluate(df: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    """df with the eight measures; errors count as formatting where only the strict rate sees them.

    Each distance is computed once, as a column, and each rate derived from it.
    """
    df = df.withColumns({"_r": tokens(reference), "_h": tokens(hypothesis), "_fr": tokens(reference, True), "_fh": tokens(hypothesis, True)})
    distance = word_distance()
    df = df.withColumns({"_d": distance("_r", "_h"), "_fd": distance("_fr", "_fh")})
    rate = lambda d, r: F.coalesce(F.try_divide(F.col(d).cast("double"), F.size(r)), F.lit(0.0))
    df = df.withColumns({"strict_wer": rate("_d", "_r"), "flexible_wer": rate("_fd", "_fr"), **character_measures(reference, hypothesis), "total_ref_words": F.size("_r")})
    total = F.greatest(F.col("total_ref_words"), F.lit(1))
    df = df.withColumn("content_errors", (F.col("flexible_wer") * total).cast("int"))
    df = df.withColumn("formatting_errors", F.greatest(F.lit(0), (F.col("strict_wer") * total).cast("int") - F.col("content_errors")))
    return df.drop("_r", "_h", "_fr", "_fh", "_d", "_fd")


def character_measures(reference: Column, hypothesis: Column) -> dict[str, Column]:
    return {
        "strict_cer": character_error_rate(reference, hypothesis),
        "flexible_cer": character_error_rate(reference, hypothesis, True),
        "total_ref_chars": F.length(characters(reference)),
    }
