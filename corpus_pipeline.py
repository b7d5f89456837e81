"""Corpus preparation: STAGES over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsieve.llm import decontaminate, minhash, mixing, quality, tokenids
from logsieve.llm.common import materialize, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the least id stays."""
    return minhash.keep_first(docs, minhash.Near(words=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark item go."""
    return decontaminate.drop_documents(docs, _table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source has its share of words."""
    return mixing.curriculum(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids in binary shards; a row for each sequence."""
    return tokenids.write_shards(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("token-ID / binary output", token_ids),
]

#: The classifier, MinHash and the permutation have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; one row for each token sequence.

    Each stage's result is written; what a stage wrote beside it, and at last the stages'
    tables too, are removed. Null texts count as empty ones; null and repeated ids take part
    (the stages' modules say how); other columns travel with their rows up to the last stage. Without
    documents there are no sequences.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as tables:
        for _, stage in STAGES[:-1]:
            with scratch(spark) as own:
                docs = materialize(stage(spark, docs, sf_dir), "stage")
                own.keep(docs)
        rows = STAGES[-1][1](spark, docs, sf_dir)
        tables.keep(rows)
    return rows
