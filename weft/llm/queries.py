"""One query for each operator, over its whole table, and the SQL that some can be checked with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weft.llm import bpe, langid, lines, media, mixing, quality, secrets, sharding, simhash, urls
from weft.llm.common import table
from weft.llm.oracles import ORACLE_SQL
from weft.plans.runtime import checkpoint_dir

__all__ = ["ORACLE_SQL", "QUERIES", "public_bpe"]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.stored_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stored.select(
        "doc_id", "stored.n_bytes", "stored.payload_bytes", "stored.payload_sha256", "stored.tail_crc32",
        F.octet_length("stored.media").cast("long").alias("media_bytes"), F.sha2("stored.media", 256).alias("media_sha256"),
        "stored.feature",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.secret_columns(docs, secrets.fit(docs)).drop("text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_bpe()
    coded = bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, "sha256")
    return coded.select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        "decoded_sha256",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, path)
    # What the result says of a record is read from its shard; the files stay, as the caller reads them.
    stored = sharding.record_digest(sharding.read_shards(docs, path), "law", "shard", "slot")
    return stored.withColumn("grown_shard", F.lit(None).cast("int"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = langid.language_columns(docs.select("doc_id", "text"), langid.fit(langid.training_rows(docs)))
    return named.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    judged = quality.judge_quality(table(spark, sf_dir, "documents"), trusted)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_removed", "text")


def public_bpe() -> tuple[str, str]:
    """The rank file and the pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_media_columns": op2_media_columns,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_language_id": op7_language_id,
    "op8_url_filters": op8_url_filters,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
}
