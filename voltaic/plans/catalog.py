"""Queries over the driver tables, one for each operator, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ilr
from ..operators import clean, cluster, markov, meanrev, series, simulate, stats
from . import adapters as A

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _ts(c: str | Column = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_SQL_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_PARTITION = ilr.chain_partition(len(A.EVENTS))
_SHARE = [f"{e}_share" for e in A.EVENTS]


def _ilr_sql(names: list[str]) -> str:
    """The coordinates of zero-replaced shares in SQL."""
    fixed = [f"(CASE WHEN {n} <= 0 THEN {ilr.ZERO_REPLACEMENT} ELSE {n} END)" for n in names]
    out = []
    for j, signs in enumerate(_PARTITION):
        up = [f"ln({x})" for x, s in zip(fixed, signs, strict=True) if s == 1]
        down = [f"ln({x})" for x, s in zip(fixed, signs, strict=True) if s == -1]
        r, s = len(up), len(down)
        out.append(f"round(sqrt({r * s}.0 / {r + s}) * (({' + '.join(up)}) / {r}.0 - ({' + '.join(down)}) / {s}.0), 6) AS ilr_{j + 1}")
    return ", ".join(out)


# --- cleaning -----------------------------------------------------------------------------------------------------------------


@_query(f"WITH {A.M}, {A.SHARES} SELECT {_SQL_TS.format('ts')} AS ts, {', '.join(f'round({e}, 4) AS {e}, round({e}_share, 6) AS {e}_share' for e in A.EVENTS)}, round(total, 4) AS total FROM s")
def hourly_pivot_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mix(spark, sf_dir)
    return m.select(_ts().alias("ts"), *[_r(e, 4).alias(e) for e in A.EVENTS], *[_r(s).alias(s) for s in _SHARE], _r("total", 4).alias("total"))


@_query(
    """WITH o AS (SELECT o_orderdate AS day, sum(o_totalprice) AS price FROM orders GROUP BY 1),
    l AS (SELECT l_shipdate AS day, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, round(price, 2) AS price, returned, quantity FROM o JOIN l USING (day)"""
)
def price_mix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("price"))
    li = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("returned"), F.sum("l_quantity").alias("quantity"))
    return o.join(li, "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), _r("price", 2).alias("price"), "returned", "quantity")


@_query(
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS bad FROM events"""
)
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.select("event_id", clean.number(F.get_json_object("props", "$.k")).alias("k"), clean.number("event_type", 0.0).alias("bad"))


@_query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE ts >= '2024-01-05' AND ts <= '2024-01-20'")
def date_range_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").where(clean.within("ts", "2024-01-05", "2024-01-20")).select("event_id", _ts().alias("ts"))


_TAGGED = """WITH x AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice - 50000 AS v, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS rn FROM orders),
 t AS (SELECT *, CASE WHEN rn > 1 THEN 'duplicate' WHEN v < 0 THEN 'negative' END AS reason FROM x)"""


def _tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") - 50000).alias("v"))
    return clean.clean(o, ["o_custkey", "o_orderdate"], ["o_orderkey"], ["v"])


@_query(_TAGGED + " SELECT o_orderkey, round(v, 2) AS v FROM t WHERE reason IS NULL")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir)[0].select("o_orderkey", _r("v", 2).alias("v"))


@_query(_TAGGED + " SELECT o_orderkey, reason FROM t WHERE reason IS NOT NULL")
def removed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir)[1].select("o_orderkey", "reason")


@_query(
    f"WITH {A.H}, g AS (SELECT series, lag(ts) OVER (PARTITION BY series ORDER BY ts) AS a, ts AS b FROM h) SELECT series, {_SQL_TS.format('a')} AS from_ts, {_SQL_TS.format('b')} AS to_ts, date_diff('second', a, b) / 3600.0 AS gap_hours FROM g WHERE date_diff('second', a, b) / 3600.0 > 1"
)
def time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.gaps(A.hourly(spark, sf_dir), "ts", ["series"], 1.0).select("series", _ts("from_ts").alias("from_ts"), _ts("to_ts").alias("to_ts"), "gap_hours")


@_query(
    f"WITH {A.M}, {A.SHARES} SELECT count(*) AS n, count(*) FILTER (click_share IS NULL) AS null_shares, count(*) FILTER (total < 0) AS negative, count(*) FILTER (error_share <= 0) AS zero_error, round(max(abs({' + '.join(_SHARE)} - 1)), 6) AS worst_sum FROM s"
)
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mix(spark, sf_dir)
    return m.agg(F.count("*").alias("n"), F.count_if(F.col("click_share").isNull()).alias("null_shares"), F.count_if(F.col("total") < 0).alias("negative"), F.count_if(F.col("error_share") <= 0).alias("zero_error"), _r(F.max(F.abs(ilr.total(_SHARE) - 1))).alias("worst_sum"))


@_query("SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:00:00') AS local_hour FROM events")
def utc_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH").alias("period"))
    return e.select("event_id", _ts(clean.local_hour("period")).alias("local_hour"))


# --- compositions -------------------------------------------------------------------------------------------------------------


@_query(f"WITH {A.M}, {A.SHARES} SELECT {_SQL_TS.format('ts')} AS ts, {_ilr_sql(_SHARE)} FROM s WHERE total > 0")
def ilr_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mix(spark, sf_dir).where("total > 0")
    return m.select(_ts().alias("ts"), *[_r(z).alias(f"ilr_{j + 1}") for j, z in enumerate(ilr.forward(ilr.replace_zeros(_SHARE), _PARTITION))])


@_query(f"WITH {A.M}, {A.SHARES}, z AS (SELECT ts, {', '.join(f'CASE WHEN {x} <= 0 THEN {ilr.ZERO_REPLACEMENT} ELSE {x} END AS {x}' for x in _SHARE)} FROM s WHERE total > 0) SELECT {_SQL_TS.format('ts')} AS ts, {', '.join(f'round({x} / ({" + ".join(_SHARE)}), 6) AS {x}' for x in _SHARE)} FROM z")
def ilr_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = A.mix(spark, sf_dir).where("total > 0").select("ts", *[c.alias(f"z{j}") for j, c in enumerate(ilr.forward(ilr.replace_zeros(_SHARE), _PARTITION))])
    return z.select(_ts().alias("ts"), *[_r(c).alias(s) for s, c in zip(_SHARE, ilr.inverse([f"z{j}" for j in range(len(_PARTITION))], _PARTITION), strict=True)])


@_query(f"WITH {A.M} SELECT count(*) AS n, true AS exact FROM m WHERE total > 0")
def ilr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = A.mix(spark, sf_dir).where("total > 0").select(*[c.alias(f"p{i}") for i, c in enumerate(ilr.replace_zeros(_SHARE))])
    parts = [f"p{i}" for i in range(len(_SHARE))]
    z = filled.select(*parts, *[c.alias(f"z{j}") for j, c in enumerate(ilr.forward(parts, _PARTITION))])
    back = ilr.inverse([f"z{j}" for j in range(len(_PARTITION))], _PARTITION)
    return z.agg(F.count("*").alias("n"), (F.max(F.greatest(*[F.abs(b - F.col(p)) for b, p in zip(back, parts, strict=True)])) < 1e-10).alias("exact"))


@_query(f"WITH {A.M}, {A.SHARES}, z AS (SELECT ts, {_ilr_sql(_SHARE).replace('round(', '(').replace(', 6) AS', ') AS')} FROM s WHERE total > 0) SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, {', '.join(f'round(avg(ilr_{j + 1}), 5) AS ilr_{j + 1}' for j in range(len(_PARTITION)))} FROM z GROUP BY 1")
def ilr_monthly_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mix(spark, sf_dir).where("total > 0")
    z = m.select("ts", *[c.alias(f"ilr_{j + 1}") for j, c in enumerate(ilr.forward(ilr.replace_zeros(_SHARE), _PARTITION))])
    return z.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), *[_r(F.avg(f"ilr_{j + 1}"), 5).alias(f"ilr_{j + 1}") for j in range(len(_PARTITION))])


# --- series -------------------------------------------------------------------------------------------------------------------

_LP = "ln(greatest(price, 0.001))"
_W = "OVER (PARTITION BY series ORDER BY ts)"


@_query(f"WITH {A.H} SELECT series, {_SQL_TS.format('ts')} AS ts, round({_LP}, 6) AS log_price, round({_LP} - lag({_LP}) {_W}, 6) AS log_return FROM h")
def log_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.order(["series"], ["ts"])
    return A.hourly(spark, sf_dir).select("series", _ts().alias("ts"), _r(series.log_price("price")).alias("log_price"), _r(series.log_return("price", w)).alias("log_return"))


@_query(f"WITH {A.H} SELECT series, {_SQL_TS.format('ts')} AS ts, round({_LP} - lag({_LP}, 6) {_W}, 6) AS r6, round({_LP} - lag({_LP}, 24) {_W}, 6) AS r24 FROM h")
def log_return_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.order(["series"], ["ts"])
    return A.hourly(spark, sf_dir).select("series", _ts().alias("ts"), _r(series.log_return("price", w, 6)).alias("r6"), _r(series.log_return("price", w, 24)).alias("r24"))


_WI = f"""WITH {A.H}, w AS (SELECT series, ts AS a, row_number() {_W} - 1 AS start_idx, lead(ts, 47) {_W} AS b FROM h),
 v AS (SELECT *, abs(date_diff('second', a, b) / 3600.0 - 47) > 2 AS vetoed FROM w WHERE start_idx % 6 = 0 AND b IS NOT NULL)"""


@_query(_WI + f" SELECT series, start_idx, {_SQL_TS.format('a')} AS start_ts, {_SQL_TS.format('b')} AS end_ts FROM v WHERE NOT vetoed")
def window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.window_index(A.hourly(spark, sf_dir), ["series"], "ts", 48, 6)
    return w.where("not vetoed").select("series", F.col("start_idx").cast("long"), _ts("start_ts").alias("start_ts"), _ts("end_ts").alias("end_ts"))


@_query(_WI + " SELECT series, count(*) AS windows, count(*) FILTER (vetoed) AS vetoed, count(*) FILTER (a <= TIMESTAMP '2024-01-10 00:00:00' AND b >= TIMESTAMP '2024-01-11 00:00:00') AS over_gap FROM v GROUP BY 1")
def window_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.window_index(A.hourly(spark, sf_dir), ["series"], "ts", 48, 6)
    known = spark.sql("SELECT timestamp_ntz'2024-01-10 00:00:00' AS gap_start, timestamp_ntz'2024-01-11 00:00:00' AS gap_end")
    kept = series.outside_gaps(w, F.broadcast(known)).groupBy("series").agg(F.count("*").alias("kept"))
    every = w.groupBy("series").agg(F.count("*").alias("windows"), F.count_if("vetoed").alias("vetoed"))
    return every.join(kept, "series", "left").select("series", "windows", "vetoed", (F.col("windows") - F.coalesce("kept", F.lit(0))).alias("over_gap"))


@_query(
    f"""WITH {A.H}, w AS (SELECT series, ts, row_number() {_W} AS i, avg(price) OVER f AS mean, stddev_pop(price) OVER f AS std, min(price) OVER f AS lo, max(price) OVER f AS hi FROM h WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT series, {_SQL_TS.format('ts')} AS end_ts, round(mean, 6) AS mean, round(std, 5) AS std, round(lo, 6) AS lo, round(hi, 6) AS hi FROM w WHERE i >= 12 AND (i - 12) % 6 = 0"""
)
def window_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.windows_of(A.hourly(spark, sf_dir), ["series"], "ts", ["price"], 12, 6)
    mean = F.aggregate("price", F.lit(0.0), lambda s, x: s + x) / F.size("price")
    var = F.aggregate(F.transform("price", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda s, x: s + x) / F.size("price")
    return w.withColumn("mean", mean).select("series", _ts("end_ts").alias("end_ts"), _r("mean").alias("mean"), _r(F.sqrt(var), 5).alias("std"), _r(F.array_min("price")).alias("lo"), _r(F.array_max("price")).alias("hi"))


@_query(
    f"""WITH {A.H}, c AS (SELECT series, ts, price - avg(price) OVER (PARTITION BY series) AS x FROM h),
    p AS (SELECT series, x, {', '.join(f'lead(x, {k}) {_W} AS l{k}' for k in (1, 6, 24, 168))} FROM c),
    s AS (SELECT series, sum(x * x) AS v, {', '.join(f'sum(x * l{k}) AS p{k}' for k in (1, 6, 24, 168))} FROM p GROUP BY 1)
    {' UNION ALL '.join(f'SELECT series, {k} AS lag, round(p{k} / nullif(v, 0), 6) AS acf FROM s' for k in (1, 6, 24, 168))}"""
)
def acf_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.autocorrelation(A.hourly(spark, sf_dir), ["series"], ["ts"], "price", (1, 6, 24, 168)).withColumn("acf", _r("acf"))


@_query()
def periodogram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest periods of each series, from 2 to 720 hours."""

    def run(pdf):
        x = pdf.sort_values("ts")["price"].to_numpy()
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2 * 2 / len(x)
        freq = np.fft.rfftfreq(len(x))
        period = np.divide(1.0, freq, out=np.full(len(freq), np.inf), where=freq > 0)
        at = [i for i in np.argsort(-power, kind="stable") if 2 <= period[i] <= 720][:5]
        return pdf.iloc[: len(at)].assign(period=period[at], power=power[at])[["series", "period", "power"]]

    return A.hourly(spark, sf_dir).select("series", "ts", "price").groupBy("series").applyInPandas(run, "series string, period double, power double")


@_query(f"WITH {A.H}, r AS (SELECT series, ts, {_LP} - lag({_LP}) {_W} AS r FROM h) SELECT series, {_SQL_TS.format('ts')} AS ts, round(stddev_samp(r) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS vol_24, round(stddev_samp(r) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 6) AS vol_168 FROM r")
def rolling_vol_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.order(["series"], ["ts"])
    r = A.hourly(spark, sf_dir).select("series", "ts", series.log_return("price", w).alias("r"))
    return r.select("series", _ts().alias("ts"), *[_r(F.stddev_samp("r").over(w.rowsBetween(1 - n, 0))).alias(f"vol_{n}") for n in (24, 168)])


@_query(
    f"WITH {A.H}, q AS (SELECT series, quantile_cont(price, 0.5) AS med, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM h WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1) SELECT h.series, {_SQL_TS.format('ts')} AS ts, round(greatest(-5, least(5, (price - med) / nullif(iqr, 0))), 6) AS scaled FROM h JOIN q USING (series)"
)
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = A.hourly(spark, sf_dir)
    q = stats.exact_percentiles(h.where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")), ["series"], "price", {"q25": 0.25, "med": 0.5, "q75": 0.75}).withColumn("iqr", F.col("q75") - F.col("q25"))
    scaled = F.try_divide(F.col("price") - F.col("med"), F.col("iqr"))
    return h.join(q, "series").select("series", _ts().alias("ts"), _r(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), scaled))).alias("scaled"))


@_query(f"WITH {A.H} SELECT series, {_SQL_TS.format('ts')} AS ts, round(sin(2 * pi() * hour(ts) / 24.0), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24.0), 6) + 0 AS hour_cos FROM h")
def cyclical_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.lit(2) * F.pi() * F.hour("ts") / F.lit(24.0)
    return A.hourly(spark, sf_dir).select("series", _ts().alias("ts"), (_r(F.sin(turn)) + 0.0).alias("hour_sin"), (_r(F.cos(turn)) + 0.0).alias("hour_cos"))


@_query(f"WITH {A.H} SELECT series, {_SQL_TS.format('ts')} AS ts, round(price - avg(price) OVER (PARTITION BY series, month(ts), hour(ts)), 6) AS detrended FROM h")
def seasonal_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series", F.month("ts"), F.hour("ts"))
    return A.hourly(spark, sf_dir).select("series", _ts().alias("ts"), _r(F.col("price") - F.avg("price").over(w)).alias("detrended"))


@_query(f"WITH {A.H} SELECT series, round(arg_max(ln(greatest(price, 0.001)), ts), 6) AS last_log_price FROM h GROUP BY 1")
def last_log_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hourly(spark, sf_dir).groupBy("series").agg(_r(F.max_by(series.log_price("price"), "ts")).alias("last_log_price"))


# --- statistics ---------------------------------------------------------------------------------------------------------------


@_query(f"WITH {A.M} SELECT CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) IN (3, 4, 5) THEN 'Spring' WHEN month(ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season, hour(ts)::INT AS hour, round(quantile_cont(total, 0.25), 5) AS q25, round(quantile_cont(total, 0.5), 5) AS q50, round(quantile_cont(total, 0.75), 5) AS q75 FROM m GROUP BY 1, 2")
def season_hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mix(spark, sf_dir)
    rows = m.select(stats.season(F.col("ts"), "Autumn").alias("season"), F.hour("ts").alias("hour"), "total")
    q = stats.exact_percentiles(rows, ["season", "hour"], "total", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return q.select("season", "hour", *[_r(n, 5).alias(n) for n in ("q25", "q50", "q75")])


@_query(f"WITH {A.M}, {A.SHARES} SELECT strftime(ts, '%Y-%m') AS month, {', '.join(f'round(avg({x}), 6) AS {x}' for x in _SHARE)} FROM s GROUP BY 1")
def monthly_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mix(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(*[_r(F.avg(x)).alias(x) for x in _SHARE])


@_query(f"WITH {A.M} SELECT month(ts)::INT AS month, {', '.join(f'round(avg(total) FILTER (hour(ts) = {i}), 5) AS h{i:02d}' for i in range(24))} FROM m GROUP BY 1")
def month_hour_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.mix(spark, sf_dir).select(F.month("ts").alias("month"), F.hour("ts").alias("hour"), "total")
    wide = m.groupBy("month").pivot("hour", list(range(24))).agg(F.avg("total"))
    return wide.select("month", *[_r(F.col(str(i)), 5).alias(f"h{i:02d}") for i in range(24)])


_PAIRS = [(a, b) for i, a in enumerate(_SHARE) for b in _SHARE[i:]]


@_query(f"WITH {A.M}, {A.SHARES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS r FROM s" for a, b in _PAIRS))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(A.mix(spark, sf_dir), _SHARE).withColumn("r", _r("r", 5))


@_query(f"WITH {A.M} " + " UNION ALL ".join(f"SELECT '{e}' AS feature, count({e}) AS n, round(min({e}), 6) AS min, round(quantile_cont({e}, 0.25), 6) AS q25, round(quantile_cont({e}, 0.5), 6) AS q50, round(quantile_cont({e}, 0.75), 6) AS q75, round(max({e}), 6) AS max, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS std FROM m" for e in A.EVENTS))
def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.describe(A.mix(spark, sf_dir), A.EVENTS, 6)


@_query("SELECT (CASE WHEN value < 0 THEN 0 WHEN value >= 1000 THEN 101 ELSE floor(value / 10.0) + 1 END)::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values below 0 and from 1,000 on are in bins of their own, 0 and 101."""
    return stats.histogram(A.table(spark, sf_dir, "events"), F.col("value"), 0.0, 1000.0, 100)


@_query("SELECT (floor((log10(greatest(value, 0.001)) + 3) / 8.0 * 79) + 1)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(A.table(spark, sf_dir, "events"), F.log10(F.greatest("value", F.lit(0.001))), -3.0, 5.0, 79)


@_query("SELECT event_type, round(quantile_cont(value, 0.99), 5) AS p99, round(quantile_cont(value, 0.025), 5) AS p025, round(quantile_cont(value, 0.975), 5) AS p975 FROM events GROUP BY 1")
def spike_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stats.exact_percentiles(A.table(spark, sf_dir, "events"), ["event_type"], "value", {"p99": 0.99, "p025": 0.025, "p975": 0.975})
    return q.select("event_type", *[_r(n, 5).alias(n) for n in ("p99", "p025", "p975")])


@_query("WITH q AS (SELECT quantile_cont(value, 0.98) AS p98 FROM events) SELECT event_id, round(least(value, p98), 6) AS clipped FROM events CROSS JOIN q")
def percentile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    top = stats.exact_percentiles(e, [], "value", {"p98": 0.98}).first().p98  # one number
    return e.select("event_id", _r(F.least("value", F.lit(top))).alias("clipped"))


@_query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def label_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


# --- vectors ------------------------------------------------------------------------------------------------------------------


@_query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").select("vec_id", _r(stats.norm("embedding")).alias("norm"))


_CH = "WITH c AS (SELECT i AS channel, sqrt(list_sum(list_transform(list_slice(embedding, i * 8 + 1, i * 8 + 8), lambda x: x::DOUBLE * x::DOUBLE))) AS nrm FROM embeddings, range(8) t(i))"


@_query(_CH + " SELECT channel::INT AS channel, round(avg(nrm), 6) AS mean, round(stddev_pop(nrm), 6) AS std, avg(nrm) < 0.01 * (SELECT avg(nrm) FROM c) AS silent FROM c GROUP BY 1")
def channel_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "embeddings").select(F.posexplode(stats.channels("embedding", 8, 8)).alias("channel", "v")).select("channel", stats.norm("v").alias("nrm"))
    by = e.groupBy("channel").agg(F.avg("nrm").alias("mean"), F.stddev_pop("nrm").alias("std"), F.count("*").alias("n"))
    whole = Window.partitionBy()  # over one row per channel
    overall = F.sum(F.col("mean") * F.col("n")).over(whole) / F.sum("n").over(whole)
    return by.select("channel", _r("mean").alias("mean"), _r("std").alias("std"), (F.col("mean") < 0.01 * overall).alias("silent"))


@_query("WITH x AS (SELECT (i - 1)::INT AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)), v AS (SELECT dim, var_pop(x) AS variance FROM x GROUP BY 1) SELECT dim, round(variance, 6) AS variance, row_number() OVER (ORDER BY variance DESC, dim)::INT AS rank, round(sum(variance) OVER (ORDER BY variance DESC, dim) / sum(variance) OVER (), 6) AS cumulative FROM v")
def variance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.variance_rank(A.table(spark, sf_dir, "embeddings"), "embedding").withColumns({"variance": _r("variance"), "cumulative": _r("cumulative")})


@_query()
def pca_k90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(cluster.pca_components(A.table(spark, sf_dir, "embeddings")),)], "k90 int")


def _points(spark: SparkSession, sf_dir: str) -> tuple[list, np.ndarray, np.ndarray]:
    """The points of a trial, which holds them all."""
    rows = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").orderBy("vec_id").toArrow()
    return rows["vec_id"].to_pylist(), np.array(rows["embedding"].to_pandas().tolist(), float), rows["label"].to_numpy()


_D = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"


@_query(
    f"""WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS lab, sum({_D}) AS s, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
    q AS (SELECT vec_id, max(CASE WHEN own = lab THEN s / n END) AS a, min(CASE WHEN own <> lab THEN s / n END) AS b FROM p GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM q"""
)
def silhouette_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.mean_silhouette(A.table(spark, sf_dir, "embeddings")).withColumn("silhouette", _r("silhouette"))


@_query(f"WITH d AS (SELECT a.vec_id, b.vec_id AS other, {_D} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS rank FROM d) SELECT vec_id, other, rank::INT AS rank, round(d, 5) AS distance FROM r WHERE rank <= 5")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.neighbours(A.table(spark, sf_dir, "embeddings"), 5).select("vec_id", "other", "rank", _r("distance", 5).alias("distance"))


def _trial(spark: SparkSession, sf_dir: str, f: Callable, schema: str) -> DataFrame:
    """All points to one task, as a clusterer needs them."""
    def run(pdf):
        pdf = pdf.sort_values("vec_id")
        return f(pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist(), float))

    return A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit(1).alias("trial")).groupBy("trial").applyInPandas(lambda pdf: run(pdf), schema)


@_query()
def tomato_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    return _trial(spark, sf_dir, lambda ids, x: pd.DataFrame({"vec_id": ids, "regime": cluster.tomato(x, 15, 10)[0]}), "vec_id long, regime int")


@_query()
def hdbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    return _trial(spark, sf_dir, lambda ids, x: pd.DataFrame({"vec_id": ids, "regime": cluster.hdbscan(x, 10)}), "vec_id long, regime int")


@_query()
def umap_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def layout(ids, x):
        y = cluster.umap(x, 15, 0.1)
        return pd.DataFrame({"vec_id": ids, "umap_1": y[:, 0].astype("float32"), "umap_2": y[:, 1].astype("float32")})

    return _trial(spark, sf_dir, layout, "vec_id long, umap_1 float, umap_2 float")


@_query()
def window_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.windows_of(A.hourly(spark, sf_dir), ["series"], "ts", ["price", "n"], 48, 6)
    return cluster.embed(w, ["series", "end_ts"], ["price", "n"])


@_query()
def forecast_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.windows_of(A.hourly(spark, sf_dir), ["series"], "ts", ["price"], 48, 6)
    return meanrev.drifts(meanrev.forecast(w, ["series", "end_ts"], "price")).drop("path")


# --- grids --------------------------------------------------------------------------------------------------------------------

_GRID = {"n_neighbors": [5, 10, 15, 30], "min_dist": ["0.0", "0.1", "0.25"], "min_cluster_size": [10, 20, 40]}
_GRID_SQL = "g AS (SELECT a AS n_neighbors, b AS min_dist, c AS min_cluster_size, (a * 7 + c * 3 + length(b) * 5) % 11 AS x FROM unnest([5, 10, 15, 30]) t(a), unnest(['0.0', '0.1', '0.25']) u(b), unnest([10, 20, 40]) v(c)), s AS (SELECT *, CASE WHEN x % 4 <> 0 THEN x / 10.0 END AS score FROM g)"


def _grid(spark: SparkSession) -> DataFrame:
    g = cluster.grid(spark, **_GRID)
    x = (F.col("n_neighbors") * 7 + F.col("min_cluster_size") * 3 + F.length("min_dist") * 5) % 11
    return g.withColumn("x", x).withColumn("score", cluster.gated(F.col("x") / F.lit(10.0), F.when(F.col("x") % 4 != 0, 0.0).otherwise(1.0)))


@_query(f"WITH {_GRID_SQL} SELECT n_neighbors::BIGINT AS n_neighbors, min_dist, min_cluster_size::BIGINT AS min_cluster_size FROM s WHERE x >= 3")
def grid_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark)
    return g.select(*_GRID).join(g.where("x < 3").select(*_GRID), list(_GRID), "left_anti")


@_query(f"WITH {_GRID_SQL} SELECT n_neighbors::BIGINT AS n_neighbors, min_dist, min_cluster_size::BIGINT AS min_cluster_size, score::DOUBLE AS score FROM s WHERE score IS NOT NULL ORDER BY score DESC, n_neighbors, min_dist, min_cluster_size LIMIT 5")
def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark).where("score is not null").orderBy(F.desc_nulls_last("score"), *_GRID).limit(5).select(*_GRID, "score")


@_query(f"WITH {_GRID_SQL} SELECT n_neighbors::BIGINT AS n_neighbors, {', '.join(f'max(score) FILTER (min_cluster_size = {c})::DOUBLE AS size_{c}' for c in _GRID['min_cluster_size'])} FROM s GROUP BY 1")
def grid_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _grid(spark).groupBy("n_neighbors").pivot("min_cluster_size", _GRID["min_cluster_size"]).agg(F.max("score"))
    return wide.select("n_neighbors", *[F.col(str(c)).alias(f"size_{c}") for c in _GRID["min_cluster_size"]])


@_query()
def grid_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each combination's layout and density clusters of the embeddings, ranked by silhouettes that aren't mostly noise."""
    points = spark.sparkContext.broadcast(_points(spark, sf_dir)[1])
    near = spark.sparkContext.broadcast(cluster.shared_knn(spark, points, max(_GRID["n_neighbors"])))  # all trials begin with these
    layout, most = ["n_neighbors", "min_dist"], max(_GRID["min_cluster_size"])

    def begin(n_neighbors, min_dist) -> tuple:
        return cluster.trial_layout(points.value, int(n_neighbors), float(min_dist), most, near=near.value)

    def trial(n_neighbors, min_dist, min_cluster_size, begun) -> dict:
        return cluster.layout_score(*begun, int(min_cluster_size))

    result = "n_neighbors long, min_dist string, min_cluster_size long, n_clusters long, noise double, silhouette double, validity double, status string"
    todo = cluster.grid(spark, **_GRID)
    dealt = todo.repartition(16 * todo.select(*layout).distinct().count() + 1, *layout)  # so many that hardly two layouts meet in a task
    found = cluster.run_grid(dealt, None, list(_GRID), trial, result, shared=layout, begin=begin).withColumn("score", cluster.gated(F.col("silhouette"), F.col("noise")))
    return cluster.ranked(found, "score", list(_GRID))


# --- Markov -------------------------------------------------------------------------------------------------------------------

_PAIR_SQL = f"{A.L}, k AS (SELECT user_id, label AS f, lead(label) OVER w AS t, ts AS a, lead(ts) OVER w AS b FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), pr AS (SELECT f AS from_label, t AS to_label FROM k WHERE f <> 'error' AND t <> 'error' AND date_diff('second', a, b) <= 360000), lab AS (SELECT DISTINCT label FROM l WHERE label <> 'error'), mat AS (SELECT x.label AS from_label, y.label AS to_label, count(pr.from_label) AS n FROM lab x CROSS JOIN lab y LEFT JOIN pr ON pr.from_label = x.label AND pr.to_label = y.label GROUP BY 1, 2), tm AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY from_label), 0), 0)::DOUBLE AS p FROM mat)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.successors(A.labels(spark, sf_dir), ["user_id"], "ts", "label", 100.0, "error", ["ts", "event_id"])


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.labels(spark, sf_dir).where("label <> 'error'").select("label").distinct()


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.transition_matrix(_pairs(spark, sf_dir), _labels(spark, sf_dir))


@_query(f"WITH {_PAIR_SQL} SELECT from_label, to_label, count(*) AS n FROM pr GROUP BY 1, 2")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("from_label", "to_label").agg(F.count("*").alias("n"))


@_query(f"WITH {_PAIR_SQL} SELECT from_label, to_label, n, round(p, 9) AS p FROM tm")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).withColumn("p", _r("p", 9))


@_query(f"WITH {_PAIR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY from_label ORDER BY p DESC, to_label) AS k FROM tm WHERE from_label <> to_label) SELECT from_label, to_label, round(p, 9) AS p FROM r WHERE k = 1 AND p >= 0.001")
def top_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.likeliest_exit(_matrix(spark, sf_dir)).select("from_label", "to_label", _r("p", 9).alias("p"))


_POWERS = ", ".join(f"m{i + 1} AS (SELECT a.from_label, b.to_label, sum(a.p * b.p) AS p FROM {'tm' if i == 0 else f'm{i}'} a JOIN {'tm' if i == 0 else f'm{i}'} b ON a.to_label = b.from_label GROUP BY 1, 2)" for i in range(6))


@_query(f"WITH {_PAIR_SQL}, {_POWERS} SELECT to_label AS label, round(avg(p), 6) AS pi FROM m6 GROUP BY 1")
def stationary_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.stationary_distribution(_matrix(spark, sf_dir)).withColumn("pi", _r("pi"))


@_query()
def bootstrap_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.bootstrap_stationary(_matrix(spark, sf_dir))


@_query(f"WITH {_PAIR_SQL} SELECT from_label AS label, round(6.0 / (1 - p), 5) AS sojourn_h FROM tm WHERE from_label = to_label")
def sojourn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.sojourn(_matrix(spark, sf_dir)).withColumn("sojourn_h", _r("sojourn_h", 5))


def _half_sql(half: int) -> str:
    """The names of the matrix's tables with a suffix, over one half of each user's rows."""
    ranked = f"(SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= count(*) OVER (PARTITION BY user_id) // 2 THEN 1 ELSE 2 END AS half FROM events) WHERE half = {half})"
    sql = _PAIR_SQL.replace("FROM events)", f"FROM {ranked}", 1)
    for name in ("l", "k", "pr", "lab", "mat", "tm"):
        sql = re.sub(rf"\b{name}\b(?=( AS \(| WINDOW| WHERE|\)|\.| x\b| y\b| ON ))", f"{name}{half}", sql)
    return sql


@_query(
    f"WITH {_half_sql(1)}, {_half_sql(2)}, j AS (SELECT a.p AS p1, b.p AS p2 FROM tm1 a FULL JOIN tm2 b USING (from_label, to_label)), d AS (SELECT sqrt(sum((p1 - p2) * (p1 - p2))) / ((sqrt(sum(p1 * p1)) + sqrt(sum(p2 * p2))) / 2 + 1e-12) AS d FROM j) SELECT round(d, 6) AS distance, d < 0.15 AS stationary FROM d"
)
def stationarity_frobenius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices of the first and the second half of each user's rows; pairs across the border count in neither."""
    split = series.halves(A.labels(spark, sf_dir), ["user_id"], ["ts", "event_id"])

    def half(n: int) -> DataFrame:
        part = split.where(F.col("half") == n)
        pairs = series.successors(part, ["user_id"], "ts", "label", 100.0, "error", ["ts", "event_id"])
        return markov.transition_matrix(pairs, part.where("label <> 'error'").select("label").distinct())

    return markov.frobenius(half(1), half(2)).withColumn("distance", _r("distance"))


_RUNS = f"{A.L}, i AS (SELECT user_id, label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, label ORDER BY ts, event_id) AS g FROM l), rn AS (SELECT user_id, label, count(*) AS length FROM i WHERE label <> 'error' GROUP BY user_id, label, g)"


@_query(f"WITH {_RUNS} SELECT label, length, count(*) AS n FROM rn GROUP BY 1, 2")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.runs(A.labels(spark, sf_dir), ["user_id"], ["ts", "event_id"], "label", "error").groupBy("label", "length").agg(F.count("*").alias("n"))


_SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}


@_query(
    f"""WITH {_PAIR_SQL}, {_POWERS}, {_RUNS[len(A.L) + 2:]}, r AS (SELECT label, avg(length) * 6 AS md, quantile_cont(length, 0.5) * 6 AS qd FROM rn GROUP BY 1), s AS (SELECT to_label AS label, avg(p) AS pi FROM m6 GROUP BY 1),
    c AS (SELECT label, count(*) AS n_obs, avg(value) AS mean_lmp, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95, {', '.join(f'100 * avg((month(ts) IN {m})::INT) AS {n}' for n, m in _SEASONS.items())}, 100 * avg((hour(ts) BETWEEN 8 AND 21)::INT) AS pk FROM l WHERE label <> 'error' GROUP BY 1)
    SELECT c.label, n_obs, round(100.0 * n_obs / sum(n_obs) OVER (), 2) AS pct_time, round(md, 1) AS mean_duration_h, round(qd, 1) AS median_duration_h, round(mean_lmp, 2) AS mean_lmp, round(med, 2) AS median_lmp, round(p5, 2) AS p5_lmp, round(p95, 2) AS p95_lmp, {', '.join(f'round({n}, 1) AS {n}_pct' for n in _SEASONS)}, round(pk, 1) AS peak_pct,
    CASE {' '.join(f"WHEN {n} = greatest({', '.join(_SEASONS)}) THEN '{n.title()}'" for n in _SEASONS)} END AS dominant_season, round(p, 4) AS self_transition, round(6 / (1 - p), 1) AS mean_sojourn_h, round(pi, 4) AS stationary_prob
    FROM c JOIN r USING (label) JOIN s USING (label) JOIN tm ON tm.from_label = c.label AND tm.to_label = c.label"""
)
def regime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.labels(spark, sf_dir).where("label <> 'error'")
    lengths = series.runs(A.labels(spark, sf_dir), ["user_id"], ["ts", "event_id"], "label", "error").groupBy("label").agg(F.avg("length").alias("md"), F.percentile("length", F.lit(0.5)).alias("qd"))
    month = F.month("ts")
    by = rows.groupBy("label").agg(
        F.count("*").alias("n_obs"),
        F.avg("value").alias("mean_lmp"),
        *[(F.avg(month.isin(*m).cast("int")) * 100).alias(s) for s, m in _SEASONS.items()],
        (F.avg(F.hour("ts").between(8, 21).cast("int")) * 100).alias("peak_pct"),
    )
    prices = stats.exact_percentiles(rows, ["label"], "value", {"median_lmp": 0.5, "p5_lmp": 0.05, "p95_lmp": 0.95})
    matrix = _matrix(spark, sf_dir)
    own = matrix.where("from_label = to_label").select(F.col("from_label").alias("label"), "p")
    whole = Window.partitionBy()  # over one row per label
    out = by.join(prices, "label").join(F.broadcast(lengths), "label").join(F.broadcast(own), "label").join(F.broadcast(markov.stationary_distribution(matrix)), "label")
    return out.select(
        "label", "n_obs", _r(100.0 * F.col("n_obs") / F.sum("n_obs").over(whole), 2).alias("pct_time"), _r(F.col("md") * 6, 1).alias("mean_duration_h"), _r(F.col("qd") * 6, 1).alias("median_duration_h"),
        *[_r(c, 2).alias(c) for c in ("mean_lmp", "median_lmp", "p5_lmp", "p95_lmp")], *[_r(s, 1).alias(f"{s}_pct") for s in _SEASONS], _r("peak_pct", 1).alias("peak_pct"),
        markov.first_best({s.title(): s for s in _SEASONS}).alias("dominant_season"), _r("p", 4).alias("self_transition"), _r(F.when(F.col("p") < 1, 6 / (1 - F.col("p"))).otherwise(float("inf")), 1).alias("mean_sojourn_h"), _r("pi", 4).alias("stationary_prob"),
    )


@_query("SELECT label, round(avg(embedding[1]), 6) AS x, round(avg(embedding[2]), 6) AS y, count(*) AS n FROM embeddings GROUP BY 1")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(_r(F.avg(F.get("embedding", F.lit(0)))).alias("x"), _r(F.avg(F.get("embedding", F.lit(1)))).alias("y"), F.count("*").alias("n"))


# --- mean reversion -----------------------------------------------------------------------------------------------------------

_DRIFT = f"{A.H}, lr AS (SELECT series, ts, {_LP} AS lp, {_LP} - lag({_LP}) {_W} AS r FROM h), dr AS (SELECT series, ts, lp, " + ", ".join(f"CASE WHEN count(r) OVER f{k} = {k} THEN sum(r) OVER f{k} END AS d{k}" for k in (1, 6, 24)) + " FROM lr WINDOW " + ", ".join(f"f{k} AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)" for k in (1, 6, 24)) + ")"
_LONG = "lo AS (" + " UNION ALL ".join(f"SELECT series, {k} AS horizon_h, lp, d{k} AS drift FROM dr" for k in (1, 6, 24)) + ")"
_FIT = "fit AS (SELECT series, horizon_h, regr_count(drift, lp)::BIGINT AS n_obs, regr_slope(drift, lp) AS slope, regr_intercept(drift, lp) AS intercept, regr_r2(drift, lp) AS r2, corr(drift, lp) AS r, sqrt((1 - regr_r2(drift, lp)) * regr_syy(drift, lp) / ((regr_count(drift, lp) - 2) * regr_sxx(drift, lp))) AS stderr FROM lo GROUP BY 1, 2 HAVING regr_count(drift, lp) >= 10)"


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.order(["series"], ["ts"])
    r = A.hourly(spark, sf_dir).select("series", "ts", series.log_price("price").alias("lp"), series.log_return("price", w).alias("r"))
    return r.select("series", "ts", "lp", *[series.drift("r", w, h).alias(f"d{h}") for h in (1, 6, 24)])


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _drift(spark, sf_dir).select("series", "lp", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon_h"), F.col(f"d{h}").alias("drift")) for h in (1, 6, 24)])))
    return meanrev.ols(long, ["series", "horizon_h"], "lp", "drift")


@_query(f"WITH {_DRIFT} SELECT series, {_SQL_TS.format('ts')} AS ts, round(lp, 6) AS log_price, round(d1, 6) AS drift_1h, round(d6, 6) AS drift_6h, round(d24, 6) AS drift_24h FROM dr")
def drift_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("series", _ts().alias("ts"), _r("lp").alias("log_price"), *[_r(f"d{h}").alias(f"drift_{h}h") for h in (1, 6, 24)])


@_query(f"WITH {_DRIFT}, {_LONG}, {_FIT} SELECT series, horizon_h, n_obs, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(r, 6) AS r, round(stderr, 6) AS stderr FROM fit")
def ols_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fits(spark, sf_dir).select("series", "horizon_h", "n_obs", *[_r(c).alias(c) for c in ("slope", "intercept", "r2", "r", "stderr")])


@_query(f"WITH {_DRIFT}, {_LONG}, {_FIT} SELECT series, horizon_h, round(CASE WHEN slope < 0 THEN -slope / horizon_h END, 6) AS theta, round(CASE WHEN slope < 0 THEN -intercept / slope END, 5) AS mu, round(CASE WHEN slope < 0 THEN ln(2) / (-slope / horizon_h) END, 5) AS half_life, slope < 0 AS valid FROM fit")
def ou_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meanrev.ou_parameters(_fits(spark, sf_dir)).select("series", "horizon_h", _r("theta").alias("theta"), _r("mu", 5).alias("mu"), _r("half_life", 5).alias("half_life"), "valid")


@_query()
def ols_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meanrev.with_p_value(_fits(spark, sf_dir)).select("series", "horizon_h", "n_obs", "p_value")


@_query(f"WITH {A.H}, r AS (SELECT series, {_LP} - lag({_LP}) {_W} AS r FROM h) SELECT series, round(stddev_pop(r), 6) AS sigma FROM r GROUP BY 1")
def sigma_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.order(["series"], ["ts"])
    r = A.hourly(spark, sf_dir).select("series", series.log_return("price", w).alias("r"))
    return meanrev.sigma(r, "r", ["series"]).withColumn("sigma", _r("sigma"))


# --- simulation ---------------------------------------------------------------------------------------------------------------


def _regimes(spark: SparkSession, sf_dir: str) -> tuple[list, list[tuple[float, float, float]], np.ndarray, float]:
    """Regimes; ``theta``, ``mu``, ``sigma`` of each from its fit at one hour (a random walk where there is no valid one); transitions; and the last log price."""
    labels, _, p = markov.as_array(_matrix(spark, sf_dir))
    fits = meanrev.ou_parameters(_fits(spark, sf_dir)).where("horizon_h = 1").select(F.col("series").alias("label"), "theta", "mu", "valid")
    r = A.hourly(spark, sf_dir).select(F.col("series").alias("label"), series.log_return("price", series.order(["series"], ["ts"])).alias("r"))
    level = A.labels(spark, sf_dir).where("label <> 'error'").groupBy("label").agg(F.avg("value").alias("mean_lmp"), F.percentile("value", F.lit(0.5)).alias("median_lmp"))
    rows = simulate.with_fallback(level.join(fits, "label", "left").join(meanrev.sigma(r, "r", ["label"]), "label", "left")).collect()  # a row per regime
    found = {x.label: (x.theta, x.mu, x.sigma) for x in rows}
    x0 = A.hourly(spark, sf_dir).agg(F.max_by(series.log_price("price"), F.struct("ts", "series"))).first()[0]
    return labels, [found[x] for x in labels], p, float(x0)


@_query()
def mc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ou, p, x0 = _regimes(spark, sf_dir)
    theta, mu, sigma = np.array(ou, float).T
    return simulate.simulate(spark, simulate.PATHS, simulate.HOURS, x0, markov.stationary(p), p, theta, mu, sigma)


@_query()
def mc_paths_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles, VaR and CVaR of the simulated paths by hour."""
    return simulate.summary(mc_paths(spark, sf_dir))


@_query()
def mc_paths_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the simulated paths in each regime, by hour."""
    return simulate.regime_frequency(mc_paths(spark, sf_dir), "hour", "regime")


_MC = "mc AS (SELECT user_id % 20 AS traj, hour(ts) AS hour, ln(greatest(value, 0.001)) AS x, exp(ln(greatest(value, 0.001))) AS y, event_type FROM events)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("traj"), F.hour("ts").alias("hour"), series.log_price("value").alias("x"), "event_type")


_QS = (("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95))


@_query(f"WITH {_MC} SELECT hour::INT AS hour, {', '.join(f'round(quantile_cont(x, {p}), 5) AS {n}, round(quantile_cont(y, {p}), 4) AS lmp_{n}' for n, p in _QS)}, round(avg(y), 4) AS lmp_mean, round(stddev_pop(y), 4) AS lmp_std FROM mc GROUP BY 1")
def mc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = simulate.summary(_paths(spark, sf_dir), "x", "hour")
    return s.select("hour", *[_r(n, 5).alias(n) for n, _ in _QS], *[_r(f"lmp_{n}", 4).alias(f"lmp_{n}") for n, _ in _QS], _r("lmp_mean", 4).alias("lmp_mean"), _r("lmp_std", 4).alias("lmp_std"))


@_query(f"WITH {_MC}, q AS (SELECT hour, quantile_cont(y, 0.05) AS v FROM mc GROUP BY 1) SELECT mc.hour::INT AS hour, round(max(v), 4) AS var_95, round(avg(y), 4) AS cvar_95 FROM mc JOIN q ON mc.hour = q.hour AND y <= v GROUP BY 1")
def var_cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.summary(_paths(spark, sf_dir), "x", "hour").select("hour", _r("var_95", 4).alias("var_95"), _r("cvar_95", 4).alias("cvar_95"))


@_query(f"WITH {_MC}, n AS (SELECT hour, event_type, count(*) AS n FROM mc GROUP BY 1, 2) SELECT hour::INT AS hour, event_type, round(n / sum(n) OVER (PARTITION BY hour), 9)::DOUBLE AS share FROM n")
def regime_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.regime_frequency(_paths(spark, sf_dir), "hour", "event_type").withColumn("share", _r("share", 9))


from . import figures  # noqa: E402, F401  registers its queries
