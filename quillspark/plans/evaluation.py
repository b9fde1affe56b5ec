"""Accuracy of extracted text against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import metrics as m
from quillspark.functions import text as tx
from quillspark.schema import PAGE

#: Largest word and character error rates that pass, by type of document.
LIMITS = {"handwritten": (0.20, 0.10), "typed": (0.40, 0.30), "mixed": (0.40, 0.20)}


def document_text(df: DataFrame) -> DataFrame:
    """(doc_id, text): texts and cells in order, without blank lines and bare name labels; needs `cells`."""
    from_text = F.when((F.col("type") == "text") & ~tx.strip(F.lower(F.coalesce("content", F.lit("")))).rlike("(?U)^(name:\\s*|\\s*)$"), F.array(F.coalesce("content", F.lit(""))))
    cells = F.filter(F.transform("cells", lambda c: tx.strip(c["content"])), lambda c: c != "")
    parts = F.when(F.col("type") == "table", cells).otherwise(from_text)
    item = F.struct(*PAGE[1:], "elem_idx", F.coalesce(parts, F.array().cast("array<string>")).alias("parts"))
    joined = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["parts"])), " ")
    return df.groupBy("doc_id").agg(tx.normalize_underscores(joined).alias("text"))


def limit(kind: Column, which: int) -> Column:
    out = F.lit(LIMITS["mixed"][which])
    for name, values in LIMITS.items():
        out = F.when(kind == name, F.lit(values[which])).otherwise(out)
    return out


def score_documents(truth: DataFrame, output: DataFrame) -> DataFrame:
    """One row a document in both: truth (doc_id, ground_truth, truth_type), output (doc_id, text, doc_type, confidence)."""
    both = truth.join(output, "doc_id").withColumn("ground_truth", tx.normalize_underscores(F.col("ground_truth")))
    both = m.evaluate(both, F.col("ground_truth"), F.col("text"))
    kind = F.coalesce("truth_type", "doc_type")
    both = both.withColumns({"wer_limit": limit(kind, 0), "cer_limit": limit(kind, 1)})
    both = both.withColumns({"wer_pass": F.col("flexible_wer") <= F.col("wer_limit"), "cer_pass": F.col("flexible_cer") <= F.col("cer_limit")})
    return both.withColumn("passed", F.col("wer_pass") & F.col("cer_pass")).drop("ground_truth", "text")


def summary(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: counts, means, and whether enough documents were scored and all passed."""
    n = truth.agg(F.count("*").alias("expected"))
    got = scored.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(a) for c, a in (("strict_wer", "avg_wer"), ("strict_cer", "avg_cer"), ("flexible_wer", "avg_flexible_wer"), ("flexible_cer", "avg_flexible_cer"))],
        F.coalesce(F.sum("formatting_errors"), F.lit(0)).alias("formatting_errors"),
        F.coalesce(F.sum("content_errors"), F.lit(0)).alias("content_errors"),
    )
    enough = (F.col("total") > 0) & (F.col("total") >= F.col("expected") / 2)
    return got.join(F.broadcast(n)).withColumn("succeeded", enough & (F.col("passed") == F.col("total")))


def compare(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Improvements in percentage points, of two summaries of one row."""
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in ("avg_wer", "avg_cer", "passed", "total")])
    both = current.join(F.broadcast(b))
    return both.select(((F.col("b_avg_wer") - F.col("avg_wer")) * 100).alias("wer_delta"), ((F.col("b_avg_cer") - F.col("avg_cer")) * 100).alias("cer_delta"), F.col("b_passed").alias("passed_before"), "passed", F.col("b_total").alias("total_before"), "total")
