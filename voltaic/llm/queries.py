"""One query per operator, over whole tables with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, kneser_ney, language_id, quality_rules, simhash_dedup, substring_dedup, token_counts, token_output, toxicity
from .common import new_folder

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket(modulus: int, column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string")) % modulus


def _held_out(modulus: int, remainder: int) -> Column:
    """False for a null key, which has no remainder; nothing is learned from it either."""
    return F.coalesce(_bucket(modulus) == remainder, F.lit(False))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_output.token_digest(spark, path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), _bucket(4) != 2)
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    prototypes = language_id.learn(docs.where(_bucket(3) != 1))
    return language_id.predict(docs, prototypes).select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def queries() -> dict:
    own = [
        op1_token_output,
        op2_token_counts,
        op3_decontaminate,
        op4_simhash_dedup,
        op5_quality_classifier,
        op6_bpe,
        op7_toxicity,
        op8_language_id,
        op9_quality_rules,
        op10_substring_dedup,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": decontaminate.ORACLE_SQL, "op9_quality_rules": quality_rules.ORACLE_SQL}
