"""A page's language: a gate on its length, then a detector; by default the one whose frequent words occur most."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip, words

FREQUENT = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for"),
    "de": ("der", "die", "und", "das", "ist", "von", "mit", "den", "ein", "nicht"),
    "fr": ("le", "la", "les", "de", "des", "est", "une", "que", "dans", "pour"),
    "es": ("el", "los", "las", "de", "que", "una", "por", "con", "para", "es"),
}


def detected(text: Column, detector=None) -> Column:
    """The detector's answer for texts of more than 20 characters, else en; ties go to the first language."""
    if detector is not None:
        answer = detector(text)
    else:
        w = F.transform(words(F.lower(text)), lambda x: F.regexp_replace(x, "[^\\p{L}]", ""))
        votes = F.array(*[_vote(w, i, k) for i, k in enumerate(FREQUENT)])
        answer = F.array_min(votes)["k"]
    return F.when(F.length(strip(text)) > 20, F.coalesce(answer, F.lit("en"))).otherwise(F.lit("en"))


def _vote(w: Column, i: int, name: str) -> Column:
    hits = F.size(F.filter(w, lambda x: x.isin(*FREQUENT[name])))
    return F.struct((-hits).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("k"))
