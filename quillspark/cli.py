"""spark-submit entry: post-process a folder of nested JSON, or score output against ground truth."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import display
from quillspark.operators import cleaning
from quillspark.plans import evaluation, pipeline
from quillspark.sources import documents, sinks


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--ground_truth")
    p.add_argument("--save-baseline")
    p.add_argument("--compare")
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--display_dir", help="where to write what a viewer shows of each element")
    p.add_argument("--show-layout", action="store_true", help="show layout regions")
    p.add_argument("--no-content", action="store_true", help="show no text")
    p.add_argument("--no-confidence", action="store_true", help="show no confidence")
    o = p.parse_args(args)
    logging.basicConfig(level=o.log_level)
    spark = SparkSession.builder.getOrCreate()
    raw = documents.read_output(spark, o.input_dir)
    steps: dict[str, Observation] = {}
    sanitized = cleaning.sanitize(raw)
    done = pipeline.postprocess(sanitized, log=steps)
    sinks.write_json(pipeline.nested(done), f"{o.output_dir}/documents")
    for name, counts in steps.items():
        logging.info("%s: %s", name, counts.get)
    if o.display_dir:
        display.shown(done, o.show_layout, not o.no_content, not o.no_confidence).write.mode("overwrite").json(o.display_dir)
    failed = documents.read_errors(spark, o.input_dir)
    sinks.error_records(failed.select(F.col("filename").alias("doc_id"), "processing_error")).select("value").write.mode("overwrite").text(f"{o.output_dir}/errors")
    if not o.ground_truth:
        return 0
    truth = documents.read_ground_truth(spark, o.ground_truth)
    kind = done.groupBy("doc_id").agg(F.min_by("document_type", "page_no").alias("doc_type"))
    text = evaluation.document_text(done).join(kind, "doc_id").withColumn("confidence", F.lit(0.0))
    summary = evaluation.summary(evaluation.score_documents(truth, text), truth)
    if o.save_baseline:
        sinks.save_baseline(summary, o.save_baseline)
    if o.compare:
        logging.info("against baseline: %s", evaluation.compare(summary, sinks.load_baseline(spark, o.compare)).first())
    result = summary.first()
    logging.info("evaluation: %s", result)
    return 0 if result["succeeded"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
