"""A corpus pipeline of operators from ``tidelog.llm``: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, mixing, quality_model, quality_rules, simhash
from tidelog.llm.common import delete, fresh_path, long_rows, scratch, small_groups


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    small_groups(spark)
    return quality_rules.keep_good(docs)


def by_quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.3 go.

    It learns from all labelled documents, as few bad ones are left among those that passed the rules.
    """
    small_groups(spark)
    labels, examples = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_model.keep_good(docs, labels, examples)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    long_rows(small_groups(spark))
    return simhash.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    long_rows(small_groups(spark))
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=1)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight, in shuffled order."""
    small_groups(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality rules", by_quality_rules),
    ("quality classifier", by_quality_model),
    ("simhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("mixing to target weights", to_target_weights),
]

#: Classifier training and graph components are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each result written to the shared folder and read again.

    A stage's input and scratch tables are deleted once its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark, "stage"):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
