"""Mean reversion: regressions of drift on level per group, Ornstein-Uhlenbeck parameters, p-values, drifts and a default forecaster."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_ROWS = 10


def ols(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = LEAST_ROWS) -> DataFrame:
    """``n_obs``, ``slope``, ``intercept``, ``r2``, ``r`` and ``stderr`` (of the slope) of y on x per group; groups of fewer than ``least`` rows are left out."""
    out = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n_obs"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
    )
    spread = F.try_divide((1 - F.col("r2")) * F.col("_syy"), (F.col("n_obs") - 2) * F.col("_sxx"))
    return out.where(F.col("n_obs") >= least).withColumn("r", F.signum("slope") * F.sqrt("r2")).withColumn("stderr", F.sqrt(spread)).drop("_sxx", "_syy")


def ou_parameters(fits: DataFrame, horizon: str = "horizon_h") -> DataFrame:
    """Add ``theta``, ``mu``, ``half_life`` (null where the slope isn't negative) and ``valid``."""
    th = -F.col("slope")
    ok = th > 0
    theta = F.when(ok, th / F.col(horizon))
    return fits.withColumns({"theta": theta, "mu": F.when(ok, F.col("intercept") / th), "half_life": F.when(ok, F.ln(F.lit(2.0)) / (th / F.col(horizon))), "valid": F.coalesce(ok, F.lit(False))})


def plausible(least_r2: float = 0.05, shortest: float = 1.0, longest: float = 720.0):
    """Condition on fits: enough explained and a half-life within bounds."""
    return (F.col("r2") >= least_r2) & F.col("half_life").between(shortest, longest)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1e-300, 1 + k * d) if 1 + k * d > 0 else 1 / min(-1e-300, 1 + k * d)
        c = 1 + k / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def slope_p_value(r2: float, n: int) -> float:
    """Two-sided probability of a slope this steep without a relation, by Student's t with n - 2 degrees of freedom."""
    if n <= 2:
        return float("nan")
    if r2 >= 1:
        return 0.0
    t2 = r2 * (n - 2) / (1 - r2)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def with_p_value(fits: DataFrame) -> DataFrame:
    """Add ``p_value``; one value per group, in Arrow batches."""

    @F.pandas_udf("double")
    def p(r2: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([slope_p_value(a, int(b)) if a == a and a is not None else None for a, b in zip(r2, n, strict=True)], dtype="float64")

    return fits.withColumn("p_value", p("r2", "n_obs"))


def sigma(df: DataFrame, c: str, keys: Sequence[str] = ()) -> DataFrame:
    """Population deviation of log-returns, over all rows by default."""
    return df.groupBy(*keys).agg(F.stddev_pop(c).alias("sigma"))


def seasonal_forecast(history: np.ndarray, steps: int, period: int = 24) -> np.ndarray:
    """The default forecaster: for each row of histories, the mean of past values at the same place in the period. Any function of this form can stand in."""
    out = np.zeros((len(history), steps))
    for k in range(steps):
        same = history[:, history.shape[1] - period + k % period :: -period] if history.shape[1] >= period - k % period else history[:, :0]
        out[:, k] = same.mean(axis=1) if same.shape[1] else 0.0
    return out


def forecast(windows: DataFrame, keys: Sequence[str], array: str, steps: int = 24, forecaster=seasonal_forecast) -> DataFrame:
    """``path``: forecast values after each window. Windows of a batch with one length are forecast together."""

    def run(batches):
        for b in batches:
            out, sizes = pd.Series([None] * len(b), index=b.index, dtype=object), b[array].map(len)
            for n, part in b.groupby(sizes, sort=False):
                out[part.index] = list(forecaster(np.array(part[array].tolist(), float).reshape(len(part), n), steps))
            yield b[list(keys)].assign(path=out)

    kinds = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys)
    return windows.select(*keys, array).mapInPandas(run, f"{kinds}, path array<double>")


def drifts(paths: DataFrame, horizons: Sequence[int] = (1, 6, 24), path: str = "path") -> DataFrame:
    """Cumulative drift of a forecast path at each horizon."""
    return paths.withColumns({f"drift_{h}h": F.aggregate(F.slice(path, 1, h), F.lit(0.0), lambda s, x: s + x) for h in horizons})


