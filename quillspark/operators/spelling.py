"""Non-words corrected to dictionary words that a recognizer could have confused them with.

The dictionary is a relation (word, freq).  Distinct unknown words are matched
with it by hashed join keys (a word with one character left out; the classes of
its letters with two intact quarters), so no pair of words is compared that
shares no key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lookalike
from quillspark.functions import text as tx
from quillspark.functions.lookalike import CONFUSED, LOST
from quillspark.operators.regions import is_text
from quillspark.schema import KEY

_PAIRS = sorted({*CONFUSED, *(p[::-1] for p in CONFUSED)})
_LOST = f"^[{LOST}]$"
LEAST_LENGTH = 5
#: Keys to which the tokens of one word are dealt.
DEALS = 16
ENDING = "[:.,;!?]+$"


def characters(w: Column) -> Column:
    return F.filter(F.split(w, ""), lambda c: c != "")


def is_plausible(wrong: Column, candidate: Column) -> Column:
    """Whether a recognizer could have read one for the other: one or two letters that look alike, or one letter lost or gained."""
    a, b = F.lower(wrong), F.lower(candidate)
    pairs = F.filter(F.zip_with(characters(a), characters(b), lambda x, y: F.concat(x, y)), lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    known = F.array(*[F.lit(p) for p in _PAIRS])
    same = F.size(pairs).between(1, 2) & F.forall(pairs, lambda p: F.array_contains(known, p))
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    lost = F.filter(F.sequence(F.lit(1), F.greatest(F.length(long), F.lit(1))), lambda i: F.concat(F.substring(long, F.lit(1), i - 1), F.substring(long, i + 1, F.length(long))) == short)
    one = F.coalesce(F.substring(long, F.get(lost, F.lit(0)), F.lit(1)).rlike(_LOST), F.lit(False))
    return F.when(F.length(a) == F.length(b), same).when(F.abs(F.length(a) - F.length(b)) == 1, one).otherwise(False)


def is_eligible(stripped: Column) -> Column:
    """Long enough, no code or compound, no acronym, no name."""
    upper = stripped.rlike("^[^\\p{Ll}]*\\p{Lu}[^\\p{Ll}]*$")
    return (F.length(stripped) >= LEAST_LENGTH) & ~(upper & (F.length(stripped) <= 6)) & ~stripped.rlike("(?U)[\\d/\\-]") & ~(F.substring(stripped, 1, 1).rlike("\\p{Lu}") & ~upper)


def corrections(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(wrong, right) for those of the distinct words in `wrong` that have a plausible correction.

    Dictionary words one edit away (a swap is one) shut out those two edits away, even if none of them is plausible; of several the most frequent wins.
    """
    keyed = lambda df, w: df.withColumn("_k", F.explode(lookalike.keys()(F.col(w))))
    pairs = keyed(unknown.select("wrong"), "wrong").join(keyed(vocabulary.select("word", "freq"), "word"), "_k").select("wrong", "word", F.col("freq").cast("long"))
    near = pairs.mapInArrow(lookalike.judged, "wrong string, word string, freq long, how byte")
    # A pair may share several keys: which word comes first stays the same.
    order = F.struct(F.col("how") == lookalike.FAR, F.col("how") == lookalike.ODD, -F.col("freq"), "word")
    first = near.select("wrong", order.cast("struct<far: boolean, odd: boolean, rare: long, word: string>").alias("c")).groupBy("wrong").agg(F.min("c").alias("c"))
    return first.where("not c.odd").select("wrong", F.col("c.word").alias("right"))


def correct_nonwords(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Text elements with their non-words corrected; case and trailing punctuation stay, blanks are collapsed."""
    text = df.where(is_text() & (F.col("content") != ""))
    parts = text.select(*KEY, F.posexplode(tx.words(F.col("content"))).alias("i", "token"))
    parts = parts.withColumn("stripped", F.regexp_replace("token", ENDING, "")).withColumn("wrong", F.when(is_eligible(F.col("stripped")), F.lower("stripped")))
    unknown = parts.where(F.col("wrong").isNotNull()).select("wrong").distinct().join(vocabulary.select(F.col("word").alias("wrong")), "wrong", "left_anti")
    # Frequent words, and those that need no correction, are dealt to several keys; else each would go to one task.
    dealt = F.xxhash64(*KEY, "i")
    parts = parts.withColumn("deal", F.when(F.col("wrong").isNotNull(), F.pmod(dealt, F.lit(DEALS))).otherwise(dealt))
    known = corrections(unknown, vocabulary).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)).cast("array<long>")))
    fixed = parts.join(known, ["wrong", "deal"], "left")
    upper = F.col("stripped") == F.upper("stripped")
    right = F.concat(F.when(upper, F.upper("right")).otherwise(F.col("right")), F.expr("substring(token, length(stripped) + 1)"))
    item = F.struct("i", F.coalesce(right, F.col("token")).alias("t"))
    lines = fixed.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ").alias("_fixed"))
    return df.join(lines, list(KEY), "left").withColumn("content", F.coalesce("_fixed", "content")).drop("_fixed")


def vocabulary_of(docs: DataFrame, least: int = 2) -> DataFrame:
    """(word, freq) from the letters-only lower-case words of a corpus; partial counts before the one shuffle."""
    w = docs.select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
