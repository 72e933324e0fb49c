"""Corpus pipeline: documents from raw rows to a training mix.

Each stage takes (spark, docs, sf_dir); run() writes what a stage returns as
Parquet and rereads it as the next stage's docs.  The stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seatwatch.llm import decontamination, mixing, near_dedup, quality, toxicity
from seatwatch.llm.queries import held_out
from seatwatch.llm.tables import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose grade is sound (1 or above) with probability of at least 0.5."""
    ratings = quality.graded_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_sound(docs, quality.fit_quality(docs, ratings, train=~held_out()))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_civil(docs, toxicity.fit_toxicity(docs, labels, train=~held_out()))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class at 0.8 similarity of five-word shingles."""
    return near_dedup.keep_first_of_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that contain no benchmark item within its edit budget."""
    return decontamination.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mix_sources(docs, mixing.cyclic_weights(docs, [5, 2, 1]))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifiers and the alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
