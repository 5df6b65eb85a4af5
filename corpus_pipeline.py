"""A training-data pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next one's docs. All but the last
return the columns of ``documents``, whatever further ones there are and whatever their names.

Null, empty and blank texts have no words and are rejected by the first stage; given to a later one, they stay as they are. Null keys are carried along; in the
near-duplicate stage they count as larger than all others. Of rows repeated with key and text that stage keeps one; the other stages treat each row alike. Very long texts
are worked on whole. Ties (of least keys, of equal texts) don't depend on partitions. An empty table passes all stages and gives an empty result with the columns of the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm import bpe, decontaminate, near_dedup, quality_rules, substring_dedup
from voltaic.llm.common import delete, intermediates, new_folder


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; ``n_chars`` follows the text."""
    return _resized(substring_dedup.dedup_texts(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and whether decoding these gives the text again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, spans=False, checked="round_trip").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", tokens),
]

#: SQL can't express the substring stage's successors; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage stores on its way, and its predecessor's output, are deleted when its own output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, name)
        with intermediates(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
