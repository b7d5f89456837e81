"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, media, minhash, mixing, oracles, quality, reclm, secrets, suffixes, tokenids, toxicity
from .common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of a shingle and least similarity in percent of op5.
NEAR = minhash.Near(words=3, percent=85)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.report(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclm.report(documents(spark, sf_dir))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(documents(spark, sf_dir), NEAR)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_token_ids,
            op2_decontaminate,
            op3_secrets,
            op4_recurrent_lm,
            op5_minhash,
            op6_mixing,
            op7_suffix_dedup,
            op8_media,
            op9_quality,
            op10_toxicity,
        )
    }


oracle_sql = oracles.oracle_sql
