"""Cleaning of raw records: coercion, shares, ranges, duplicates with an audit trail, gaps, pivots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(c: str | Column, default: float | None = None) -> Column:
    """A number, or null (or the default) where the text is none; NaN counts as missing."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    x = F.when(F.isnan(x), None).otherwise(x)
    return F.coalesce(x, F.lit(default)) if default is not None else x


def hour_start(date: str, hour_ending: str, strict: bool = False) -> Column:
    """``MM/dd/yyyy`` and hour ending to the hour's start. A label that is no number counts as 0, hence 23:00 of the day before, unless strict."""
    hour = F.col(hour_ending).try_cast("int")
    hour = hour if strict else F.coalesce(hour, F.lit(0))
    return (F.try_to_timestamp(F.col(date), F.lit("MM/dd/yyyy")) + F.make_dt_interval(F.lit(0), hour - 1)).cast("timestamp_ntz")


def local_hour(period: str, zone: str = "America/New_York") -> Column:
    """``yyyy-MM-dd'T'HH`` in UTC to naive local time; the hours of a clock change collapse."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.try_to_timestamp(F.col(period), F.lit("yyyy-MM-dd'T'HH")).cast("timestamp_ntz"))


def pivot_sum(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column of sums for each of the given names; absent ones are 0."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.sum(value)).fillna(0.0, subset=list(names))


def with_shares(df: DataFrame, parts: Sequence[str], total: str = "total") -> DataFrame:
    """Add the row total and the share of each part (null where the total is 0)."""
    whole = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in parts])
    return df.withColumn(total, whole).withColumns({f"{p}_share": F.try_divide(F.col(p), F.col(total)) for p in parts})


def within(c: str, start: str, end: str) -> Column:
    """Inclusive range of timestamps; a date stands for its midnight."""
    return F.col(c).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def tag_removed(df: DataFrame, key: Sequence[str], order: Sequence[str], not_negative: Sequence[str]) -> DataFrame:
    """Add ``reason``: 'duplicate' for all but the first row of a key, then 'negative' for rows with a negative value, else null."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    below = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in not_negative], F.lit(False))
    return df.withColumn("_place", place).withColumn("reason", F.when(F.col("_place") > 1, "duplicate").when(below, "negative")).drop("_place")


def clean(df: DataFrame, key: Sequence[str], order: Sequence[str], not_negative: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and the removed ones with their reason."""
    tagged = tag_removed(df, key, order, not_negative)
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def all_null(columns: Sequence[str]) -> Column:
    return F.coalesce(*columns).isNull()


def gaps(df: DataFrame, ts: str, series: Sequence[str] = (), hours: float = 2.0) -> DataFrame:
    """``from_ts``, ``to_ts``, ``gap_hours`` where successive rows of a series are more than ``hours`` apart."""
    before = F.lag(ts).over(Window.partitionBy(*series).orderBy(ts))
    apart = F.timestamp_diff("SECOND", F.col("from_ts"), F.col("to_ts")) / F.lit(3600.0)
    return df.select(*series, before.alias("from_ts"), F.col(ts).alias("to_ts")).withColumn("gap_hours", apart).where(F.col("gap_hours") > hours)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of the columns is missing, as NaN counts too."""
    return df.dropna(subset=list(columns))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``nulls`` of each column, in one pass."""
    row = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns])
    return df.agg(row.alias("r")).select(F.inline("r"))


def require_finite(df: DataFrame, array: str) -> DataFrame:
    """The table itself; raises ValueError if any value of the array is missing or infinite."""
    if bad := not_finite(df, array):
        raise ValueError(f"{bad} rows have a missing or infinite value in {array}")
    return df


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    """Names of the columns with a prefix, in the table's order."""
    return [c for c in df.columns if c.startswith(prefix)]


def gathered(df: DataFrame, prefix: str, out: str) -> DataFrame:
    """Columns ``prefix0``, ``prefix1``, ... put into one array, in order of their number."""
    names = sorted(prefixed(df, prefix), key=lambda c: int(c[len(prefix) :]))
    return df.select(*[c for c in df.columns if c not in names], F.array(*names).alias(out))


def spread(df: DataFrame, array: str, prefix: str, count: int) -> DataFrame:
    """The first ``count`` values of an array as columns ``prefix0``, ``prefix1``, ..."""
    return df.select(*[c for c in df.columns if c != array], *[F.get(array, F.lit(i)).alias(f"{prefix}{i}") for i in range(count)])


def not_finite(df: DataFrame, array: str) -> int:
    """Rows whose array has a missing or infinite value; for checks that must fail early."""
    bad = F.exists(array, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(F.count_if(bad | F.col(array).isNull())).first()[0]
