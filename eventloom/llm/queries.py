"""The corpus operators as queries over the tables of a folder, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, media, mixing, pii, secrets, sharding, simhash, substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary of the registered queries: EVENTLOOM_TOKENIZER, else the installed public one."""
    if named := os.environ.get("EVENTLOOM_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), kept=False)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.contents(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("redacted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_secrets": op4_secrets,
    "op5_media": op5_media,
    "op6_ann": op6_ann,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op7_sharding": sharding.SQL}
