"""Ordered operations on series: differences, sliding windows, run lengths, successors. All are partitioned by the series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FLOOR = 1e-3


def order(series: Sequence[str], by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*series).orderBy(*by)


def log_price(c: str, floor: float = FLOOR) -> Column:
    return F.ln(F.greatest(F.col(c), F.lit(floor)))


def log_return(c: str, w: WindowSpec, lag: int = 1) -> Column:
    """Difference of logarithms over rows, not over time; null for the first ``lag`` rows."""
    return log_price(c) - F.lag(log_price(c), lag).over(w)


def with_index(df: DataFrame, series: Sequence[str], by: Sequence[str], name: str = "idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(order(series, by)) - 1)


def window_index(df: DataFrame, series: Sequence[str], ts: str, length: int, stride: int, tolerance_h: float = 2.0) -> DataFrame:
    """``start_idx``, ``start_ts``, ``end_ts`` and ``vetoed`` of each sliding window of rows; its label is its last time.
    Vetoed are windows whose span differs from ``length - 1`` hours by more than the tolerance. Moves no row data."""
    w = order(series, [ts])
    span = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts")) / F.lit(3600.0)
    rows = df.select(*series, F.col(ts).alias("start_ts"), (F.row_number().over(w) - 1).alias("start_idx"), F.lead(ts, length - 1).over(w).alias("end_ts"))
    return rows.where((F.col("start_idx") % stride == 0) & F.col("end_ts").isNotNull()).withColumn("vetoed", F.abs(span - (length - 1)) > tolerance_h)


def outside_gaps(windows: DataFrame, known: DataFrame) -> DataFrame:
    """Windows that don't span a known gap (``gap_start``, ``gap_end``)."""
    cond = (windows["start_ts"] <= known["gap_start"]) & (windows["end_ts"] >= known["gap_end"])
    return windows.join(known, cond, "left_anti")


def windows_of(df: DataFrame, series: Sequence[str], ts: str, channels: Sequence[str], length: int, stride: int) -> DataFrame:
    """One array of each channel for each window of rows, nulls kept in place. A row goes to the windows that it lies in, ``length / stride`` of them, so
    only rows of windows that are returned are gathered."""
    rows = with_index(df.select(*series, ts, *channels), series, [ts], "_i")
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - length + 1) / F.lit(stride)))
    starts = F.sequence(first.cast("int"), F.floor(F.col("_i") / stride).cast("int"))
    member = rows.select("*", F.explode(F.when(first <= F.floor(F.col("_i") / stride), starts)).alias("_w"))
    row = F.struct("_i", F.col(ts).alias("_ts"), *[F.col(c).alias(f"_c{n}") for n, c in enumerate(channels)])
    whole = member.groupBy(*series, "_w").agg(F.sort_array(F.collect_list(row)).alias("_rows")).where(F.size("_rows") == length)
    part = lambda name: F.transform("_rows", lambda x: x[name])
    return whole.select(*series, F.col("_rows")[length - 1]["_ts"].alias("end_ts"), *[part(f"_c{n}").alias(c) for n, c in enumerate(channels)])


def first_windows(windows: DataFrame, series: Sequence[str], by: str, most: int) -> DataFrame:
    """At most so many windows of each series, the earliest."""
    return windows.withColumn("_k", F.row_number().over(order(series, [by]))).where(F.col("_k") <= most).drop("_k")


def contexts(ends: DataFrame, df: DataFrame, series: Sequence[str], ts: str, c: str, length: int, skip_first: bool = True) -> DataFrame:
    """``history``: the ``length`` values up to the row at each exact time of ``ends``; times without such a row, with too few rows before it or a missing value among
    them give none. With ``skip_first`` a time needs ``length`` rows before it, not ``length - 1``, which leaves out the very first window."""
    rows = with_index(df.select(*series, ts, c), series, [ts], "_i")
    at = ends.select(*series, ts).distinct().join(rows.select(*series, ts, "_i"), [*series, ts]).where(F.col("_i") >= (length if skip_first else length - 1))
    wanted = at.select(*series, ts, F.explode(F.sequence(F.col("_i") - length + 1, F.col("_i"))).alias("_i"))
    value = F.struct("_i", F.col(c).alias("_x"))
    found = wanted.join(rows.select(*series, "_i", c), [*series, "_i"]).groupBy(*series, ts).agg(F.sort_array(F.collect_list(value)).alias("_rows"), F.count(c).alias("_n"))
    return found.where(F.col("_n") == length).select(*series, ts, F.transform("_rows", lambda x: x["_x"]).alias("history"))


def halves(df: DataFrame, series: Sequence[str], by: Sequence[str], name: str = "half") -> DataFrame:
    """Add 1 for the first half of a series' rows (the smaller one if their number is odd), else 2."""
    rows = F.count("*").over(Window.partitionBy(*series))
    return df.withColumn(name, F.when(F.row_number().over(order(series, by)) <= F.floor(rows / 2), 1).otherwise(2))


def successors(df: DataFrame, series: Sequence[str], ts: str, label: str, most_h: float = 7.0, noise: str | int = -1, by: Sequence[str] | None = None) -> DataFrame:
    """``from_label``, ``to_label`` of adjacent rows at most ``most_h`` hours apart, neither of them noise."""
    w = order(series, by or [ts])
    pairs = df.select(*series, F.col(label).alias("from_label"), F.lead(label).over(w).alias("to_label"), F.col(ts).alias("_a"), F.lead(ts).over(w).alias("_b"))
    near = F.timestamp_diff("SECOND", F.col("_a"), F.col("_b")) <= most_h * 3600
    return pairs.where(near & (F.col("from_label") != noise) & (F.col("to_label") != noise)).drop("_a", "_b")


def runs(df: DataFrame, series: Sequence[str], by: Sequence[str], label: str, noise: str | int = -1) -> DataFrame:
    """``label``, ``length`` (rows) of maximal runs of one label; runs of noise are dropped, but split others."""
    island = F.row_number().over(order(series, by)) - F.row_number().over(order([*series, label], by))
    found = df.withColumn("_island", island).groupBy(*series, label, "_island").agg(F.count("*").alias("length"))
    return found.where(F.col(label) != noise).drop("_island")


def autocorrelation(df: DataFrame, series: Sequence[str], by: Sequence[str], c: str, lags: Sequence[int]) -> DataFrame:
    """``lag``, ``acf``: the biased estimate at the given lags."""
    w = order(series, by)
    whole = Window.partitionBy(*series)
    centred = df.select(*series, *by, (F.col(c) - F.avg(c).over(whole)).alias("_x"))
    led = centred.withColumns({f"_l{k}": F.lead("_x", k).over(w) for k in lags})
    sums = led.groupBy(*series).agg(F.sum(F.col("_x") ** 2).alias("_s"), *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_p{k}") for k in lags])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_p{k}"), F.col("_s")).alias("acf")) for k in lags])
    return sums.select(*series, F.inline(pairs))


def correlogram(df: DataFrame, series: Sequence[str], by: str, c: str, most: int = 720, block: int = 16_384) -> DataFrame:
    """``lag`` 1 to ``most``, ``acf`` (the biased estimate) and ``ci`` (1.96 / sqrt n) of each series. Lagged products are summed over blocks of rows, each with the rows
    that follow it up to the greatest lag, so that a long series is many tasks; sums over blocks are exact."""
    rows = with_index(df.where(F.col(c).isNotNull()).select(*series, by, c), series, [by], "_i")
    level = rows.groupBy(*series).agg(F.avg(c).alias("_mean"), F.count("*").alias("_n"))
    at = F.floor(F.col("_i") / block)
    blocks = F.when((F.col("_i") % block < most) & (at > 0), F.array(at - 1, at)).otherwise(F.array(at))
    dealt = rows.join(level, list(series)).select(*series, "_i", "_n", (F.col(c) - F.col("_mean")).alias("_x"), F.explode(blocks).alias("_b"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in series)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        x, start = pdf["_x"].to_numpy(float), int(pdf["_b"].iloc[0]) * block
        own = x * (pdf["_i"].to_numpy() < start + block)
        size = 1 << int(np.ceil(np.log2(2 * len(x) + 1)))
        total = np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(x, size), size)
        lags = np.arange(min(most, len(x) - 1, int(pdf["_n"].iloc[0]) - 1) + 1)
        return pd.DataFrame({k: pdf[k].iloc[0] for k in series} | {"lag": lags, "total": total[lags], "n": pdf["_n"].iloc[0]})

    sums = dealt.groupBy(*series, "_b").applyInPandas(products, f"{kinds}, lag long, total double, n long").groupBy(*series, "lag", "n").agg(F.sum("total").alias("total"))
    whole = sums.where("lag = 0").select(*series, F.col("total").alias("_v"))
    return sums.where("lag > 0").join(whole, list(series)).select(*series, "lag", F.try_divide("total", "_v").alias("acf"), (F.lit(1.96) / F.sqrt("n")).alias("ci"))


def loess(df: DataFrame, series: Sequence[str], by: str, c: str, span: int = 169, block: int = 4_096) -> DataFrame:
    """``trend``: a local line through the ``span`` nearest rows of each row, with tricube weights. Rows are fitted by blocks, each with the rows around it that it needs."""
    rows = with_index(df.select(*series, by, c), series, [by], "_i").withColumn("_n", F.count("*").over(Window.partitionBy(*series)))
    near = F.sequence(F.floor((F.col("_i") - span) / block), F.floor((F.col("_i") + span) / block))
    dealt = rows.select("*", F.explode(near).alias("_b")).where(F.col("_b") >= 0)
    kept = df.select(*series, by, c).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        i, y, n = pdf["_i"].to_numpy(), pdf[c].to_numpy(float), int(pdf["_n"].iloc[0])
        own = np.flatnonzero(i // block == pdf["_b"].iloc[0])
        if not len(own):
            return pdf.iloc[:0].assign(trend=0.0)[[*kept.names, "trend"]]
        width = min(span, n)
        lo = np.clip(i[own] - width // 2, 0, n - width) - i[0]
        cols = lo[:, None] + np.arange(width)
        d = (i[cols] - i[own][:, None]).astype(float)
        w = np.clip(1 - (np.abs(d) / (np.abs(d).max(axis=1, keepdims=True) + 1e-9)) ** 3, 0, 1) ** 3
        s0, s1, s2 = w.sum(axis=1), (w * d).sum(axis=1), (w * d * d).sum(axis=1)
        t0, t1 = (w * y[cols]).sum(axis=1), (w * d * y[cols]).sum(axis=1)
        det = s0 * s2 - s1 * s1
        line = np.where(det > 1e-9, (s2 * t0 - s1 * t1) / np.where(det > 1e-9, det, 1), t0 / s0)
        return pdf.iloc[own].assign(trend=line)[[*kept.names, "trend"]]

    return dealt.groupBy(*series, "_b").applyInPandas(fit, f"{out}, trend double")


def drift(c: str, w: WindowSpec, horizon: int) -> Column:
    """Sum of the next ``horizon`` values; null if there are fewer."""
    frame = w.rowsBetween(1, horizon)
    return F.when(F.count(c).over(frame) == horizon, F.sum(c).over(frame))
