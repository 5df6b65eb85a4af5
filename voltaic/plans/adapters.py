"""Canonical shapes of the driver tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ilr
from ..operators import clean, markov

#: Event types, as parts of a composition and as labels.
EVENTS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hour(c: str = "ts"):
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series`` (event type), ``ts`` (hour), ``price`` (mean value), ``n``."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), _hour().alias("ts")).agg(F.avg("value").alias("price"), F.count("*").alias("n"))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts`` (hour), a sum of values for each event type, their total and shares."""
    events = table(spark, sf_dir, "events").select(_hour().alias("ts"), "event_type", "value")
    return clean.with_shares(clean.pivot_sum(events, ["ts"], "event_type", "value", EVENTS), EVENTS)


def fuel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts`` (hour), a sum of values for each of the eight parts of the domain's composition (users are dealt to parts by their number), their total and shares."""
    part = F.element_at(F.array(*map(F.lit, ilr.PARTS)), (F.col("user_id") % 8 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select(_hour().alias("ts"), part.alias("part"), "value")
    return clean.with_shares(clean.pivot_sum(events, ["ts"], "part", "value", ilr.PARTS), ilr.PARTS)


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts`` (hour), ``regime`` (the event type with the greatest sum, the first winning ties; errors count as noise) and ``total``."""
    return mix(spark, sf_dir).select("ts", markov.first_best({e: e for e in EVENTS}).alias("regime"), "total")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each user's event: its type; errors count as noise."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("label"), "value")


H = "h AS (SELECT event_type AS series, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS price, count(*) AS n FROM events GROUP BY 1, 2)"
M = (
    "m0 AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, "
    + ", ".join(f"coalesce(sum(value) FILTER (event_type = '{e}'), 0) AS {e}" for e in EVENTS)
    + " FROM events GROUP BY 1), m AS (SELECT *, "
    + " + ".join(EVENTS)
    + " AS total FROM m0)"
)
F8 = (
    "f0 AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, "
    + ", ".join(f"coalesce(sum(value) FILTER (user_id % 8 = {i}), 0) AS {p}" for i, p in enumerate(ilr.PARTS))
    + " FROM events GROUP BY 1), f1 AS (SELECT *, "
    + " + ".join(ilr.PARTS)
    + " AS total FROM f0), f AS (SELECT ts, total, "
    + ", ".join(f"{p} / nullif(total, 0) AS {p}_share" for p in ilr.PARTS)
    + " FROM f1)"
)
R = "rg AS (SELECT ts, total, CASE " + " ".join(f"WHEN {e} = greatest({', '.join(EVENTS)}) THEN '{e}'" for e in EVENTS) + " END AS regime FROM m)"
SHARES = "s AS (SELECT *, " + ", ".join(f"{e} / nullif(total, 0) AS {e}_share" for e in EVENTS) + " FROM m)"
L = "l AS (SELECT user_id, ts, event_id, event_type AS label, value FROM events)"
