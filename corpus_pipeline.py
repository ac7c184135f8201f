"""Corpus preparation end to end: each stage's output is written as Parquet and read again as the next one's documents.

All stages take documents with nulls in any column, empty and very long texts, repeated rows, tied or repeated ids and
further columns of any name (which they drop), and empty tables, which give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, langid, mixing, secrets, simhash
from eventloom.llm.common import Written, scratch
from eventloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of its n-grams that the chosen language's filter must explain; text in a known language has far more.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that the labelled ones teach; a missing label becomes the language found.

    Null texts, texts without a letter and texts of which less than LEAST_SCORE of the n-grams speak for any language
    go; all go where nothing is labelled. Repeated rows and rows without an id stay.
    """
    filters = langid.train(docs)
    found = langid.predict(docs, filters, keep={c: c for c in COLUMNS})
    known = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The smallest id stays, rows without an id give way to others; of repeated rows one stays. Different texts of one id
    are told apart. A null or wordless text is a copy of equal texts only, null being equal to empty.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each secret in its place and counts characters anew; all rows stay, repeated ones too, and null
    texts stay null."""
    found = secrets.scan(docs, keep={c: c for c in COLUMNS})
    masked = found.withColumn("text", secrets.mask_spans(F.col("text"), F.col("found")))
    return masked.withColumn("n_chars", F.when(F.size("found") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most; documents without words, null texts too, go.

    The null source is a source of its own. Equal rows share what the mix takes of them.
    """
    return mixing.repeated(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids' and the decoded texts' digests of every document that is left, a row each; null texts count as empty."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix_sources), ("bpe", encode)]

#: The stages go beyond what SQL can say; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the documents; each stage's tables are dropped once the next one's are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(f"pipeline-{name}"):
            after = Written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        before, docs = after, after.df
    return STAGES[-1][1](spark, docs, sf_dir)
