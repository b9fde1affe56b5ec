"""From raw documents to a shuffled training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  `run` writes what a stage returns to the
shared folder and hands the table that was read back to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, mixing, near_dup, quality, sharding
from quillspark.llm._io import Table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity band reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays, the one of the smallest doc_id."""
    return near_dup.deduplicate(docs, near_dup.NearDupParams(shingle=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share by weight: documents of sources in demand are repeated, of others left out."""
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def external_shuffle(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of equal row counts in shuffled order."""
    return sharding.assign(docs, sharding.ShardParams(shards=16))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mix sources", mix_sources),
    ("external shuffle", external_shuffle),
]

#: Kneser-Ney perplexity and alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = Table(docs, name.replace(" ", "-")).df
    return docs
