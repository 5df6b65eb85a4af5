"""Markov chains of labels: transitions, stationary distribution, bootstrap, stationarity, regime statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transition_matrix(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``from_label``, ``to_label``, ``n``, ``p`` on the full grid of labels (one column, ``label``); rows without transitions are zero."""
    counts = pairs.groupBy("from_label", "to_label").agg(F.count("*").alias("n"))
    # A grid of labels, of the size of the matrix that is returned.
    grid = labels.select(F.col("label").alias("from_label")).join(labels.select(F.col("label").alias("to_label")), F.lit(True))
    full = grid.join(counts, ["from_label", "to_label"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    share = F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("from_label")).cast("double"))
    return full.withColumn("p", F.coalesce(share, F.lit(0.0)))


def as_array(matrix: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Labels, counts and probabilities of a matrix, which is of the size of its labels squared."""
    rows = matrix.collect()
    labels = sorted({r.from_label for r in rows})
    at = {x: i for i, x in enumerate(labels)}
    n, p = np.zeros((len(labels),) * 2), np.zeros((len(labels),) * 2)
    for r in rows:
        n[at[r.from_label], at[r.to_label]], p[at[r.from_label], at[r.to_label]] = r.n, r.p
    return labels, n, p


def stationary(p: np.ndarray) -> np.ndarray:
    """The left eigenvector to the eigenvalue nearest to 1, made a distribution."""
    values, vectors = np.linalg.eig(p.T)
    v = np.abs(np.real(vectors[:, np.argmin(np.abs(values - 1))]))
    return v / v.sum()


def stationary_distribution(matrix: DataFrame) -> DataFrame:
    labels, _, p = as_array(matrix)
    pi = stationary(p) if labels else []
    return matrix.sparkSession.createDataFrame([(x, float(y)) for x, y in zip(labels, pi, strict=True)], f"label {matrix.schema['from_label'].dataType.simpleString()}, pi double")


def bootstrap_stationary(matrix: DataFrame, samples: int = 1_000, seed: int = 42) -> DataFrame:
    """``label``, ``mean``, ``lo``, ``hi`` (2.5 and 97.5 percent) of the stationary distribution over multinomial resamples of each row.
    Each resample has a generator of its own, so the partitions don't matter."""
    labels, n, p = as_array(matrix)
    kind = matrix.schema["from_label"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                rng = np.random.default_rng([seed, i])
                q = np.array([rng.multinomial(int(k), r / r.sum()) / k if (k := c.sum()) > 0 else r for c, r in zip(n, p, strict=True)])
                yield pd.DataFrame({"label": labels, "pi": stationary(q)})

    drawn = matrix.sparkSession.range(samples).mapInPandas(run, f"label {kind}, pi double")
    return drawn.groupBy("label").agg(F.avg("pi").alias("mean"), F.percentile("pi", F.lit(0.025)).alias("lo"), F.percentile("pi", F.lit(0.975)).alias("hi"))


def frobenius(first: DataFrame, second: DataFrame, limit: float = 0.15) -> DataFrame:
    """``distance`` of two matrices relative to their mean norm, and ``stationary`` (below the limit); null for different labels."""
    both = first.select("from_label", "to_label", F.col("p").alias("p1")).join(second.select("from_label", "to_label", F.col("p").alias("p2")), ["from_label", "to_label"], "full")
    norm = lambda c: F.sqrt(F.sum(F.col(c) ** 2))
    gap = F.sqrt(F.sum((F.col("p1") - F.col("p2")) ** 2)) / ((norm("p1") + norm("p2")) / 2 + 1e-12)
    same = F.count_if(F.col("p1").isNull() | F.col("p2").isNull()) == 0
    return both.agg(F.when(same, gap).alias("distance")).withColumn("stationary", F.col("distance") < limit)


def likeliest_exit(matrix: DataFrame, least: float = 1e-3) -> DataFrame:
    """The best other label of each row, the first label winning ties."""
    w = Window.partitionBy("from_label").orderBy(F.desc("p"), "to_label")
    return matrix.where("from_label <> to_label").withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("p") >= least)).drop("_r")


def sojourn(matrix: DataFrame, step_h: float = 6.0) -> DataFrame:
    """Mean time in a label: step / (1 - p), infinite where p is 1."""
    p = F.col("p")
    return matrix.where("from_label = to_label").select(F.col("from_label").alias("label"), F.when(p < 1, F.lit(step_h) / (1 - p)).otherwise(F.lit(float("inf"))).alias("sojourn_h"))


def first_best(values: dict[str, str]):
    """The name of the greatest of some columns, the first winning ties."""
    top = F.greatest(*values.values())
    out = F.when(F.col(next(iter(values.values()))) == top, next(iter(values)))
    for name, c in list(values.items())[1:]:
        out = out.when(F.col(c) == top, name)
    return out


