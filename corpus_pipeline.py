"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``; the last
returns them once per copy that the mix takes, with copy, shard and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import read, stage
from cohortkit.llm.decontamination import decontaminate
from cohortkit.llm.line_dedup import drop_lines, empty_state, insert_documents
from cohortkit.llm.mixing import mixed_rows
from cohortkit.llm.ngram_join import keep_one_per_group
from cohortkit.llm.quality_rules import quality_filter

#: SQL cannot express the stages that fit thresholds, follow links or draw at random.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the base rules or the certified cutoffs reject go."""
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines found in ten documents or more go; n_chars follows the text."""
    out = drop_lines(insert_documents(empty_state(spark, min_docs=10), docs), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of linked documents stays."""
    return keep_one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a passage of the benchmark go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: a row for each copy of a document that the mix takes."""
    return mixed_rows(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates),
          ("decontamination", benchmark), ("mixing", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
