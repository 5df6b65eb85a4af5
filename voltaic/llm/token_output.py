"""Token ids in Parquet: one row per document, in ascending order of its key.

Columns of a token table: the key, further metadata columns on request, ``n_tokens`` (long) and ``ids`` (array<int>, the end id included).
The ids are dictionary encoded, keys and counts delta encoded; row groups and pages are small enough that the page index lets a reader
fetch the tokens of a few documents, or the metadata of all, alone. A table is a folder of files in key order; rows of a file are in order.

A null text counts as an empty one: its only id is the end id. The string of a special token in a text is that token, unless ``literal`` is set. Null keys come first. Repeated keys stay together, in an order that depends
on their texts alone. Metadata columns may have any name but ``n_tokens`` and ``ids``, which raise an error. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encode_bytes, gathered, ids_array, with_columns
from .common import small_batches, tidied

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000


def write_tokens(
    df: DataFrame, path: str, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = (), literal: bool = False
) -> None:
    """Encode whole texts and write them as a token table. One shuffle of the texts by ranges of the key; the ids go straight to the files."""
    if clash := {"n_tokens", "ids"} & {key, *meta}:
        raise ValueError(f"names of a token table's own columns: {sorted(clash)}")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    schema = T.StructType(
        [df.schema[c] for c in (key, *meta)] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            parts = [p + end for p in encode_bytes(b.column(text), tokenizer, literal)]
            new = {"n_tokens": pa.array([len(p) // 4 for p in parts], pa.int64()), "ids": ids_array(parts)}
            yield with_columns(b, new).select(schema.names)

    ordered = (
        df.select(key, *meta, text).repartitionByRange(F.col(key)).sortWithinPartitions(F.col(key), F.xxhash64(text), F.xxhash64(*meta, F.lit(0)))
    )
    small_batches(ordered).mapInArrow(tidied(run), schema).write.options(
        **{
            "compression": "zstd",
            "parquet.block.size": ROW_GROUP_BYTES,
            "parquet.page.size": PAGE_BYTES,
            "parquet.page.row.count.limit": PAGE_ROWS,
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            f"parquet.enable.dictionary#{key}": "false",
            "parquet.enable.dictionary#n_tokens": "false",
        }
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A token table, or some of its columns; filters on the key reach the page index."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``row`` and ``start`` (ids of all rows before it) of each row. Reads keys and counts only; the running sum is taken
    within files, and over one row per file."""
    df = spark.read.parquet(path)
    key = df.columns[0]
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(key).alias("key"), "n_tokens")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("key").alias("first"))
    order = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.select("file", "row", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("before"))
        .join(files, "file")
        .select("file", "row", (F.col("base") + F.col("before")).alias("start"))
    )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per row of a token table, from its files: key, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    df = spark.read.parquet(path)
    key = df.columns[0]
    schema = T.StructType(
        [df.schema[key], T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("file"), b.column("row"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=schema.names
            )

    rows = df.select(key, "ids", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).mapInArrow(tidied(run), schema)
    return rows.join(token_starts(spark, path), ["file", "row"]).select(key, "start", "n_tokens", "ids_crc32")
