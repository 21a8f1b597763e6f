"""From raw documents to token ids, in five stages, each of which applies one operator to all that is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.llm import bpe, langid, lines, mixing, simhash
from weft.llm.queries import public_bpe
from weft.plans.runtime import checkpoint_dir, remove, shrink

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or a word of a learned language, go. A missing label is filled with the prediction."""
    shrink(spark)
    named = langid.language_columns(docs, langid.fit(langid.training_rows(docs)))
    kept = named.filter((F.col("lang_pred") != "und") & (F.col("lang_score") > 0)).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line once: texts lose repeated lines. Documents of which nothing is left but blanks go."""
    shrink(spark)
    clean = lines.dedup_lines(docs)
    kept = clean.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a Jaccard similarity of five-word shingles of 0.8 or more."""
    shrink(spark)
    return simhash.drop_similar(docs, width=5, least=0.8).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's repetition rate says."""
    shrink(spark)
    return mixing.mix_sources(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (little-endian, 32 bits each), their number, and the hash of the decoded bytes."""
    shrink(spark)
    coded = bpe.encode_texts(docs, *public_bpe(), "sha256")
    return coded.select(
        *COLUMNS,
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        "token_ids",
        "decoded_sha256",
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned languages, SimHash and BPE aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again.

    A stage's input goes once its result is written; the last result stays, as the caller reads it.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
