"""Corpus pipeline: toxicity, near duplicates, benchmark text, personal data, tokens.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  ``run`` writes what a
stage returns as Parquet into the shared folder and reads it back as the next
stage's ``docs``.  All stages but the last return the columns of ``docs``; the
last adds ``ids`` and ``n_tokens``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from punctual.llm import bpe, decontamination, ngram_join, pii, queries, toxicity
from punctual.llm._store import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more as toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, queries.toxic_labels(spark, sf_dir)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, Jaccard 0.8)."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go."""
    return decontamination.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks; all documents stay."""
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs, *queries.byte_bpe())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", one_of_each), ("decontamination", drop_contaminated),
          ("pii", redact), ("bpe", tokenize)]

#: Toxicity and the vocabulary are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
