"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

``classify`` scores words (``word_model``): trigrams of all trusted texts meet each document's in shards, a slice of them at a time.
Each text gets its perplexity, and is kept if that is at most its language's limit: the ``QUANTILE`` of the perplexities of trusted texts in that
language, times ``MARGIN``. A model of words knows its own texts by heart, so the limits are those of one in ``HELD_OUT`` trusted texts under a model of the
others. Languages without such text take the quantile of all. Quantiles are exact for perplexities rounded to a thousandth of their
logarithm, and need no language in one task.

Null and empty texts have no perplexity (null) and aren't kept. With no trusted text the model is uniform and has no limit: all other texts are kept.
A null language is a language of its own. Repeated rows count as often as they occur. The result has the key, ``lang``, ``n_scored`` (long),
``perplexity``, ``threshold`` (double) and ``kept`` (boolean); other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import word_model
from .common import few, stored

QUANTILE = 0.99
MARGIN = 1.25
#: One in so many trusted texts sets the limits, by a model of the others.
HELD_OUT = 5
_BINS = 1_000.0


def limits(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> tuple[DataFrame, float | None]:
    """``lang``, ``threshold`` by language, however many; and the one of all languages together, None without any text."""
    bins = stored(scored.where("perplexity is not null").select("lang", F.round(F.ln("perplexity") * _BINS).cast("long").alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n")))

    def limit(table: DataFrame, *by: str) -> DataFrame:
        group = Window.partitionBy(*by)
        ranked = table.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
        return ranked.where(F.col("upto") >= F.col("total") * quantile).groupBy(*by).agg((F.exp(F.min("bin") / _BINS) * margin).alias("threshold"))

    # The bins of a logarithm are few, whatever the languages.
    every = limit(bins.groupBy("bin").agg(F.sum("n").alias("n"))).first()
    return limit(bins, "lang"), every["threshold"] if every else None


def classify(df: DataFrame, trusted_keys: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Perplexity, threshold and verdict of each document; ``trusted_keys`` has the keys of those to learn from."""
    df = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("lang"))  # so that no column's name can clash
    keys = few(stored(trusted_keys.select(F.col(key).alias("_trusted")).where("_trusted is not null").distinct()))
    marked = df.join(keys, df["_key"] == F.col("_trusted"), "left").withColumn("_held", F.coalesce(F.crc32(F.col("_key").cast("string")) % HELD_OUT == 0, F.lit(False)))
    scored = stored(word_model.perplexities(marked.withColumn("_trusted", F.col("_trusted").isNotNull()), "_key", "_text", "lang", "_trusted", "_held"))
    own = scored.select("lang", F.col("rest").alias("perplexity")).where("perplexity is not null")
    if own.isEmpty():  # too few trusted texts to hold any out
        own = scored.where("flag > 0")
    by_lang, every = limits(own, quantile, margin)
    by_lang = by_lang.withColumnRenamed("lang", "_lang")
    joined = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["_lang"]), "left")
    limit = F.coalesce("threshold", F.lit(float("inf") if every is None else every))
    return joined.select(F.col("_key").alias(key), "lang", "n_scored", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))
