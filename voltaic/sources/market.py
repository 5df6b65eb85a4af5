"""Readers of raw market files and small sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A comma outside of quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_tagged(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """D lines of all tagged files under a path, as strings, with the file they come from. A file's first H line names its columns; columns that a file lacks are
    null, values that a line lacks are empty, further values are left out, as are files without a header."""
    line = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    cell = F.transform(F.split("value", _COMMA), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), '""', '"'))
    cells = line.select("file", "block", "at", cell.alias("cells")).withColumn("tag", F.get("cells", F.lit(0))).withColumn("cells", F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))))
    header = cells.where("tag = 'H'").groupBy("file").agg(F.min(F.struct("block", "at", "cells"))["cells"].alias("names"))
    rows = cells.where("tag = 'D'").join(F.broadcast(header), "file")  # one header a file
    value = lambda c: F.when(F.array_contains("names", c), F.coalesce(F.get("cells", F.array_position("names", c).cast("int") - 1), F.lit("")))
    return rows.select("file", *[value(c).alias(c) for c in columns])


def fetch_pages(fetch: Callable[[int, int], list], size: int = 5_000) -> Iterator:
    """Records of pages by offset, up to a short, empty or failing one; pages read before it are kept."""
    offset = 0
    while True:
        try:
            page = fetch(offset, size)
        except OSError:
            return
        yield from page
        if len(page) < size:
            return
        offset += size


def read_paged(spark: SparkSession, names: Sequence[str], fetch: Callable[[str, int, int], list], schema: str, size: int = 5_000) -> DataFrame:
    """Records of a paged service, a task for each name; ``fetch(name, offset, size)`` gives a page of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["name"]:
                pages = fetch_pages(lambda offset, n, name=name: fetch(name, offset, n), size)
                while part := list(islice(pages, size)):
                    yield pd.DataFrame(part, columns=[c.split()[0] for c in schema.split(", ")])

    wanted = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)), "name")
    return wanted.mapInPandas(run, schema)


def hub_rows(df: DataFrame, hub: str, name: str = "Location Name", kind: str = "Location Type", group: str = "file") -> DataFrame:
    """Rows of a hub; in files without it, those of kind HUB."""
    has = df.groupBy(group).agg(F.max(F.col(name) == hub).alias("_has"))
    return df.join(has, group).where(F.when(F.col("_has"), F.col(name) == hub).otherwise(F.col(kind) == "HUB")).drop("_has")


def read_records(spark: SparkSession, path: str, fuels: dict[str, str]) -> DataFrame:
    """``period``, ``fueltype`` (mapped, else lower-cased), ``value`` of paged JSON responses."""
    schema = "response struct<data: array<struct<period: string, fueltype: string, value: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("response.data"))
    names = F.create_map(*[F.lit(x) for pair in fuels.items() for x in pair]) if fuels else None
    mapped = F.coalesce(names[F.col("fueltype")], F.lower("fueltype")) if fuels else F.lower("fueltype")
    return rows.withColumn("fueltype", mapped)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialised(spark: SparkSession, path: str, make, fresh: bool = False) -> DataFrame:
    """A stored result, made only if it isn't there or is to be made afresh."""
    if fresh or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    """Add finished trials to a table of results."""
    df.write.mode("append").parquet(path)


def write_json_row(df: DataFrame, path: str) -> None:
    """A one-row document."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table of results with a header, as ``write_csv`` makes it."""
    return spark.read.schema(schema).csv(path, header=True)


def purge(spark: SparkSession, *paths: str) -> None:
    """Delete a stage's own outputs, for a fresh start."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def concat(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, matched by name; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
