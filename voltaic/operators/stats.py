"""Statistics of tables: profiles, percentiles, correlations, histograms, vector norms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(c: str, *at: float) -> list[Column]:
    """Exact percentiles with linear interpolation."""
    return [F.percentile(c, F.lit(p)).alias(f"q{round(p * 100):02d}") for p in at]


#: Leading bits of a number that make its range.
RANGE_BITS = 16
#: Groups up to which the ranges that are wanted may be broadcast.
MOST_GROUPS = 20_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], c: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles (linear interpolation) of each group by name, null where it has no value. No task holds a group: values are counted by range, the leading bits of
    their ordered binary form, and only the ranges that hold a wanted rank are counted by value, with the counts combined before the shuffle."""
    keys = list(keys)
    one = F.lit(1).alias("_one") if not keys else None
    rows = df.select(*keys, *([one] if not keys else []), F.col(c).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    by = keys or ["_one"]
    # A double's bits, in the order of its value: the exponent and the first bits of the fraction say enough for a range. Zeros are one value.
    size = F.floor(F.log2(F.greatest(F.abs("_x"), F.lit(1e-300))) * (1 << RANGE_BITS - 11)).cast("long")
    base = 1 << 20
    rows = rows.withColumn("_r", F.when(F.abs("_x") <= 1e-300, 0).when(F.col("_x") > 0, base + size).otherwise(-(base + size)))
    ranges = rows.groupBy(*by, "_r").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    wanted = F.array(*[F.struct(F.lit(n).alias("_name"), F.floor(F.lit(float(p)) * (F.col("_all") - 1) + d).cast("long").alias("_rank"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("_place")) for n, p in at.items() for d in (0, 1)])
    ranks = ranges.select(*by, "_r", "_n", "_before", "_all", F.inline(wanted)).withColumn("_rank", F.least("_rank", F.col("_all") - 1)).distinct()
    ranks = ranks.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    held = ranks.select(*by, "_r", "_before").distinct()
    if not keys or ranges.select(*by).distinct().count() <= MOST_GROUPS:
        held = F.broadcast(held)  # two ranges at most for each group and percentile
    values = rows.join(held, [*by, "_r"]).groupBy(*by, "_r", "_before", "_x").agg(F.count("*").alias("_k"))
    within = Window.partitionBy(*by, "_r").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_lo", F.col("_before") + F.coalesce(F.sum("_k").over(within), F.lit(0)))
    found = ranks.select(*by, "_r", "_name", "_rank", "_place").join(values, [*by, "_r"]).where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_lo") + F.col("_k")))
    part = F.max("_place") - F.floor(F.max("_place"))
    value = F.min("_x") + (F.max("_x") - F.min("_x")) * part
    got = found.groupBy(*by, "_name").agg(value.alias("_v")).groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in at])
    return got if keys else got.drop("_one")


def season(ts: Column, autumn: str = "Fall") -> Column:
    """Winter is December to February."""
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").otherwise(autumn)


def describe(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Count, mean, sample deviation and quartiles of each column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])))
    q = exact_percentiles(long, ["feature"], "x", {"min": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "max": 1.0})
    level = long.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    parts = ("min", "q25", "q50", "q75", "max", "mean", "std")
    return level.join(q, "feature", "left").select("feature", "n", *[F.round(c, digits).alias(c) for c in parts])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns over rows where both are known."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs])
    return df.agg(row.alias("r")).select(F.inline("r"))


def histogram(df: DataFrame, x: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """``bin`` (1 to ``bins``; 0 and ``bins + 1`` beyond the edges) and ``n``."""
    return df.where(x.isNotNull()).groupBy(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def norm(array: str | Column) -> Column:
    return F.sqrt(F.aggregate(array, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def channels(array: str, count: int, width: int) -> Column:
    """A vector cut into ``count`` channels of ``width`` values; null unless it has exactly so many."""
    return F.when(F.size(array) == count * width, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(F.col(array), i * width + 1, F.lit(width))))


def variance_rank(df: DataFrame, array: str) -> DataFrame:
    """``dim``, ``variance``, ``rank`` and cumulative share of each dimension by population variance. One row per dimension reaches the window."""
    by_dim = df.select(F.posexplode(array).alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))
    w = Window.orderBy(F.desc("variance"), "dim")
    whole = Window.partitionBy()
    return by_dim.select("dim", "variance", F.row_number().over(w).alias("rank"), (F.sum("variance").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("variance").over(whole)).alias("cumulative"))


def components_for(ranked: DataFrame, *shares: float) -> DataFrame:
    """``n90``, ``n95``, ... of a variance rank: how many dimensions have such a share of the variance."""
    return ranked.agg(*[F.min(F.when(F.col("cumulative") >= s - 1e-12, F.col("rank"))).alias(f"n{round(s * 100)}") for s in shares])


def box(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """Quartiles, and the whiskers: the farthest values within 1.5 quartile ranges."""
    q = exact_percentiles(df, keys, c, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = df.join(q, list(keys)).where(F.col(c).between(F.col("q25") - reach, F.col("q75") + reach))
    return inside.groupBy(*keys, "q25", "q50", "q75").agg(F.min(c).alias("low"), F.max(c).alias("high"))


def normal_plot(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """``n`` and ``r2`` of a line through the sorted values over the normal quantiles of their places (Filliben's)."""
    rows = df.where(F.col(c).isNotNull())
    n = F.count("*").over(Window.partitionBy(*keys))
    placed = rows.select(*keys, c, F.row_number().over(Window.partitionBy(*keys).orderBy(c)).alias("i"), n.alias("n"))
    last = F.pow(F.lit(0.5), 1 / F.col("n"))
    share = F.when(F.col("i") == F.col("n"), last).when(F.col("i") == 1, 1 - last).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        inverse = NormalDist().inv_cdf
        return p.map(lambda x: inverse(x) if 0 < x < 1 else None)

    fitted = placed.withColumn("z", quantile(share)).groupBy(*keys, "n").agg(F.corr(c, "z").alias("r"))
    return fitted.select(*keys, "n", (F.col("r") ** 2).alias("r2"))


def standardised(df: DataFrame, keys: Sequence[str], c: str, out: str) -> DataFrame:
    """Add a column less its mean, by its population deviation, both by key."""
    level = df.groupBy(*keys).agg(F.avg(c).alias("_mean"), F.stddev_pop(c).alias("_std"))
    return df.join(level, list(keys)).withColumn(out, F.try_divide(F.col(c) - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same for a seed whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
