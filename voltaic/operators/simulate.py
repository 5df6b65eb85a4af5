"""Regime-switching Ornstein-Uhlenbeck paths and their risk summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import exact_percentiles

BLOCK_HOURS = 6
PATHS, HOURS = 1_000, 720


def chunk_paths(rng: np.random.Generator, size: int, hours: int, x0: float, pi: np.ndarray, p: np.ndarray, theta: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log prices by path and hour, and regimes by path and block; all paths advance together.

    A regime holds for a block of hours. Within it dx = theta (mu - x) dt + sigma dW, so that with steps of an hour the distance to mu shrinks by 1 - theta and gets noise.
    """
    blocks = -(-hours // BLOCK_HOURS)
    cumulative = np.cumsum(np.vstack([p, pi]), axis=1)
    last = len(pi) - 1

    def draw(rows: np.ndarray) -> np.ndarray:
        return np.minimum((rng.random(size)[:, None] > cumulative[rows]).sum(axis=1), last)

    regime = np.empty((size, blocks), np.int64)
    regime[:, 0] = draw(np.full(size, last + 1))
    for b in range(1, blocks):
        regime[:, b] = draw(regime[:, b - 1])
    by_hour = np.repeat(regime, BLOCK_HOURS, axis=1)[:, :hours]
    noise = sigma[by_hour] * rng.standard_normal((size, hours))
    keep, level = 1 - theta[by_hour], theta[by_hour] * mu[by_hour]
    price, x = np.empty((size, hours)), np.full(size, float(x0))
    for h in range(hours):
        x = keep[:, h] * x + level[:, h] + noise[:, h]
        price[:, h] = x
    return price, regime


def simulate(spark: SparkSession, paths: int, hours: int, x0: float, pi, p, theta, mu, sigma, seed: int = 42, chunks: int = 10) -> DataFrame:
    """``traj_id``, ``hour``, ``log_lmp``, ``regime``. Each chunk has a generator seeded by its number, so results don't depend on partitions."""
    args = [np.asarray(a, float) for a in (pi, p, theta, mu, sigma)]
    base = paths // chunks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["id"]:
                size = base + (paths - base * chunks if c == chunks - 1 else 0)
                if not size:
                    continue
                x, s = chunk_paths(np.random.default_rng(seed + c), size, hours, x0, *args)
                yield pd.DataFrame({"traj_id": np.repeat(c * base + np.arange(size), hours), "hour": np.tile(np.arange(1, hours + 1), size), "log_lmp": x.ravel(), "regime": np.repeat(s, BLOCK_HOURS, axis=1)[:, :hours].ravel()})

    return spark.range(0, chunks, 1, chunks).mapInPandas(run, "traj_id long, hour long, log_lmp double, regime long")


def with_fallback(regimes: DataFrame) -> DataFrame:
    """``label``, ``theta``, ``mu``, ``sigma``: those of a valid fit, or a random walk by the regime's ``mean_lmp`` and ``median_lmp``."""
    ok = F.coalesce("valid", F.lit(False))
    walk = {"theta": F.lit(0.0), "mu": F.ln(F.greatest("median_lmp", F.lit(1e-3))), "sigma": F.col("mean_lmp") * 0.02}
    return regimes.select("label", *[F.when(ok, F.col(c)).otherwise(x).alias(c) for c, x in walk.items()])


def summary(paths: DataFrame, x: str = "log_lmp", hour: str = "hour") -> DataFrame:
    """Quantiles of x and of exp(x), mean, population deviation, VaR (5 percent) and CVaR (mean at most VaR) per hour."""
    at = (0.05, 0.25, 0.5, 0.75, 0.95)
    priced = paths.withColumn("_p", F.exp(x))
    names = [f"q{round(q * 100):02d}" for q in at]
    q = priced.groupBy(hour).agg(F.avg("_p").alias("lmp_mean"), F.stddev_pop("_p").alias("lmp_std"))
    for c, prefix in ((x, ""), ("_p", "lmp_")):
        q = q.join(exact_percentiles(priced, [hour], c, {f"{prefix}{n}": a for a, n in zip(at, names, strict=True)}), hour)
    q = q.select(hour, *names, *[f"lmp_{n}" for n in names], "lmp_mean", "lmp_std")
    tail = priced.join(q.select(hour, "lmp_q05"), hour).where(F.col("_p") <= F.col("lmp_q05")).groupBy(hour).agg(F.avg("_p").alias("cvar_95"))
    return q.join(tail, hour, "left").withColumn("var_95", F.col("lmp_q05"))


def regime_frequency(paths: DataFrame, step: str = "step", regime: str = "regime") -> DataFrame:
    """Share of trajectories in each regime at each step."""
    n = paths.groupBy(step, regime).agg(F.count("*").alias("n"))
    total = n.groupBy(step).agg(F.sum("n").alias("total"))
    return n.join(total, step).select(step, regime, (F.col("n") / F.col("total")).alias("share"))


def terminal(paths: DataFrame, at: int, x: str = "log_lmp", hour: str = "hour") -> DataFrame:
    """The summary of one hour, with the 95th percentile and the median of exp(x)."""
    last = paths.where(F.col(hour) == at)
    return summary(last, x, hour).select(hour, "lmp_q05", "lmp_q50", "lmp_q95", "lmp_mean", "lmp_std", "var_95", "cvar_95")


def wide(paths: DataFrame, hours: int, x: str = "log_lmp", prefix: str = "h") -> DataFrame:
    """A row for each path, with a column for each hour (``h001`` on)."""
    row = paths.groupBy("traj_id").agg(F.map_from_entries(F.collect_list(F.struct("hour", x))).alias("m"))
    return row.select("traj_id", *[F.element_at("m", F.lit(h).cast(paths.schema["hour"].dataType)).cast("float").alias(f"{prefix}{h:03d}") for h in range(1, hours + 1)])
