"""Queries of the domain's own composition, of regimes against prices, and behind the figures; the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features, ilr
from ..operators import clean, cluster, markov, meanrev, series, simulate, stats
from ..sources import market
from . import adapters as A
from . import catalog as C
from .catalog import _LP, _SQL_TS, _W, _query, _r, _ts

_F = [f"{p}_share" for p in ilr.PARTS]
_Z = [f"ilr_{j + 1}" for j in range(7)]


def _z_sql(digits: int | None = None) -> str:
    """The seven coordinates of the eight parts in SQL."""
    fixed = [f"(CASE WHEN {n} <= 0 THEN {ilr.ZERO_REPLACEMENT} ELSE {n} END)" for n in _F]
    out = []
    for j, signs in enumerate(ilr.PARTITION):
        up, down = ([f"ln({x})" for x, s in zip(fixed, signs, strict=True) if s == side] for side in (1, -1))
        r, s = len(up), len(down)
        z = f"sqrt({r * s}.0 / {r + s}) * (({' + '.join(up)}) / {r}.0 - ({' + '.join(down)}) / {s}.0)"
        out.append(f"{z if digits is None else f'round({z}, {digits})'} AS {_Z[j]}")
    return ", ".join(out)


_ZF = f"{A.F8}, z AS (SELECT ts, total, {_z_sql()} FROM f WHERE total > 0)"


def _coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.fuel_mix(spark, sf_dir).where("total > 0")
    return m.select("ts", "total", *[z.alias(n) for z, n in zip(ilr.forward(ilr.replace_zeros(_F), ilr.PARTITION), _Z, strict=True)])


# --- the eight parts ----------------------------------------------------------------------------------------------------------


@_query(f"WITH {A.F8} SELECT {_SQL_TS.format('ts')} AS ts, {_z_sql(6)} FROM f WHERE total > 0")
def fuel_ilr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coordinates(spark, sf_dir).select(_ts().alias("ts"), *[_r(z).alias(z) for z in _Z])


@_query(f"WITH {A.F8} SELECT count(*) AS n, true AS exact FROM f WHERE total > 0")
def fuel_ilr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = A.fuel_mix(spark, sf_dir).where("total > 0").select(*[c.alias(f"p{i}") for i, c in enumerate(ilr.replace_zeros(_F))])
    parts = [f"p{i}" for i in range(8)]
    z = filled.select(*parts, *[c.alias(n) for c, n in zip(ilr.forward(parts, ilr.PARTITION), _Z, strict=True)])
    back = ilr.inverse(_Z, ilr.PARTITION)
    return z.agg(F.count("*").alias("n"), (F.max(F.greatest(*[F.abs(b - F.col(p)) for b, p in zip(back, parts, strict=True)])) < 1e-10).alias("exact"))


@_query(f"WITH {_ZF} SELECT round(avg(ilr_7), 6) AS noon, avg(ilr_7) > 0 AS positive FROM z WHERE hour(ts) = 12 AND month(ts) IN (1, 6, 7, 8)")
def sign_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last coordinate at noon of some months (January too, as the events have no other)."""
    noon = _coordinates(spark, sf_dir).where((F.hour("ts") == 12) & F.month("ts").isin(1, 6, 7, 8))
    return noon.agg(F.avg("ilr_7").alias("noon")).select(_r("noon").alias("noon"), (F.col("noon") > 0).alias("positive"))


@_query(f"WITH {_ZF} SELECT month(ts)::INT AS month, {', '.join(f'round(avg(ilr_7) FILTER (hour(ts) = {i}), 5) AS h{i:02d}' for i in range(24))} FROM z GROUP BY 1")
def month_hour_ilr7(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _coordinates(spark, sf_dir).select(F.month("ts").alias("month"), F.hour("ts").alias("hour"), "ilr_7")
    wide = z.groupBy("month").pivot("hour", list(range(24))).agg(F.avg("ilr_7"))
    return wide.select("month", *[_r(F.col(str(i)), 5).alias(f"h{i:02d}") for i in range(24)])


def _long(z: DataFrame) -> DataFrame:
    return z.select(F.inline(F.array(*[F.struct(F.lit(n).alias("coordinate"), F.col(n).alias("x")) for n in _Z])))


@_query(
    f"WITH {_ZF}, lo AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS coordinate, {n} AS x FROM z' for n in _Z)}), q AS (SELECT coordinate, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75 FROM lo GROUP BY 1) "
    "SELECT coordinate, round(q25, 5) AS q25, round(q50, 5) AS q50, round(q75, 5) AS q75, round(min(x), 5) AS low, round(max(x), 5) AS high FROM lo JOIN q USING (coordinate) WHERE x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) GROUP BY coordinate, q25, q50, q75"
)
def ilr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.box(_long(_coordinates(spark, sf_dir)), ["coordinate"], "x").select("coordinate", *[_r(c, 5).alias(c) for c in ("q25", "q50", "q75", "low", "high")])


@_query(f"WITH {A.F8}, n AS (SELECT avg(total) AS m, stddev_pop(total) AS s FROM f) SELECT {_SQL_TS.format('ts')} AS ts, round((total - m) / nullif(s, 0), 6) AS norm_load, round(1 - coalesce(wind_share, 0) - coalesce(solar_share, 0), 6) AS net_share, round(greatest(-1, least(1, (gas - other) / nullif(abs(gas + other), 0))), 6) AS congestion FROM (SELECT *, natural_gas_share AS gas, other_share AS other FROM f) x CROSS JOIN n")
def load_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised load, the share that neither wind nor solar covers, and a clipped ratio of a difference to a price level."""
    m = stats.standardised(A.fuel_mix(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], "total", "norm_load")
    ratio = F.try_divide(F.col("natural_gas_share") - F.col("other_share"), F.abs(F.col("natural_gas_share") + F.col("other_share")))
    net = 1 - F.coalesce("wind_share", F.lit(0.0)) - F.coalesce("solar_share", F.lit(0.0))
    # greatest and least skip nulls, in both dialects.
    return m.select(_ts().alias("ts"), _r("norm_load").alias("norm_load"), _r(net).alias("net_share"), _r(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))).alias("congestion"))


@_query(f"WITH {A.F8} SELECT column_name AS \"column\", nulls FROM (SELECT {', '.join(f'count(*) FILTER ({p} IS NULL) AS {p}' for p in _F)} FROM f) UNPIVOT (nulls FOR column_name IN ({', '.join(_F)}))")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.null_counts(A.fuel_mix(spark, sf_dir), _F)


_FEATURES = ["log_return", *_Z]


@_query(f"WITH {_ZF}, r AS (SELECT ts, ln(greatest(total, 0.001)) - lag(ln(greatest(total, 0.001))) OVER (ORDER BY ts) AS log_return, {', '.join(_Z)} FROM z) SELECT {_SQL_TS.format('ts')} AS ts, round(log_return, 6) AS log_return FROM r WHERE log_return IS NOT NULL AND {' AND '.join(f'{z} IS NOT NULL' for z in _Z)}")
def complete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the feature vector without a missing value; the first has no return."""
    z = _coordinates(spark, sf_dir).withColumn("series", F.lit("all"))
    full = z.withColumn("log_return", series.log_return("total", series.order(["series"], ["ts"])))
    return clean.complete(full, features.active({"log_return": True, "log_price": False}, dict.fromkeys(_Z, True))).select(_ts().alias("ts"), _r("log_return").alias("log_return"))


@_query("SELECT o_orderkey, o_orderstatus, o_orderdate::DATE::VARCHAR AS o_orderdate, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders")
def prefix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    return o.select(*clean.prefixed(o, "o_order"), "o_totalprice").withColumns({"o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"), "o_totalprice": _r("o_totalprice", 2)})


@_query("SELECT count(*) AS n, count(*) FILTER (list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))) AS bad FROM embeddings")
def finite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails if any vector has a missing or infinite value."""
    e = clean.require_finite(A.table(spark, sf_dir, "embeddings"), "embedding")
    return e.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("bad"))


@_query("SELECT strftime(day, '%Y-%m-%d') AS day, source, amount FROM (SELECT o_orderdate AS day, 'orders' AS source, round(o_totalprice, 2) AS amount FROM orders UNION ALL SELECT l_shipdate, 'lineitem', round(l_extendedprice, 2) FROM lineitem)")
def union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day"), F.lit("orders").alias("source"), _r("o_totalprice", 2).alias("amount"))
    li = A.table(spark, sf_dir, "lineitem").select(_r("l_extendedprice", 2).alias("amount"), F.lit("lineitem").alias("source"), F.col("l_shipdate").alias("day"))
    return market.concat(o, li).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@_query("SELECT DISTINCT user_id FROM events WHERE dayofmonth(ts) = 1 EXCEPT SELECT user_id FROM events WHERE dayofmonth(ts) = 2")
def label_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.where(F.dayofmonth("ts") == 1).select("user_id").subtract(e.where(F.dayofmonth("ts") == 2).select("user_id"))


# --- series -------------------------------------------------------------------------------------------------------------------


@_query(
    f"""WITH {A.H}, c AS (SELECT series, row_number() {_W} AS i, price - avg(price) OVER (PARTITION BY series) AS x, count(*) OVER (PARTITION BY series) AS n FROM h), v AS (SELECT series, n, sum(x * x) AS v FROM c GROUP BY 1, 2)
    SELECT a.series, b.i - a.i AS lag, round(sum(a.x * b.x) / nullif(v.v, 0), 6) AS acf, round(1.96 / sqrt(v.n), 6) AS ci FROM c a JOIN c b ON a.series = b.series AND b.i > a.i AND b.i <= a.i + 720 JOIN v ON v.series = a.series GROUP BY a.series, b.i - a.i, v.v, v.n"""
)
def acf_720(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation at every lag up to 720 hours."""
    return series.correlogram(A.hourly(spark, sf_dir), ["series"], "ts", "price", block=4_096).select("series", "lag", _r("acf").alias("acf"), _r("ci").alias("ci"))


_ENDS = C._WI + f", x AS (SELECT series, ts, price, row_number() {_W} - 1 AS i FROM h)"


@_query(_ENDS + f", e AS (SELECT v.series, v.b AS ts, x.i FROM v JOIN x ON x.series = v.series AND x.ts = v.b WHERE NOT vetoed AND x.i >= 24) SELECT e.series, {_SQL_TS.format('e.ts')} AS ts, count(*) AS n, round(avg(x.price), 6) AS mean, round(arg_min(x.price, x.i), 6) AS first, round(arg_max(x.price, x.i), 6) AS last FROM e JOIN x ON x.series = e.series AND x.i > e.i - 24 AND x.i <= e.i GROUP BY e.series, e.ts")
def window_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 prices up to the end of each window."""
    h = A.hourly(spark, sf_dir)
    ends = series.window_index(h, ["series"], "ts", 48, 6).where("not vetoed").select("series", F.col("end_ts").alias("ts"))
    got = series.contexts(ends, h, ["series"], "ts", "price", 24)
    mean = F.aggregate("history", F.lit(0.0), lambda s, x: s + x) / F.size("history")
    return got.select("series", _ts().alias("ts"), F.size("history").cast("long").alias("n"), _r(mean).alias("mean"), _r(F.get("history", F.lit(0))).alias("first"), _r(F.element_at("history", -1)).alias("last"))


@_query(C._WI + f", r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY b) AS k FROM v WHERE NOT vetoed) SELECT series, {_SQL_TS.format('b')} AS end_ts FROM r WHERE k <= 20")
def capped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.window_index(A.hourly(spark, sf_dir), ["series"], "ts", 48, 6).where("not vetoed")
    return series.first_windows(w, ["series"], "end_ts", 20).select("series", _ts("end_ts").alias("end_ts"))


@_query(f"WITH {A.H}, x AS (SELECT series, ts, {_LP} AS lp FROM h) SELECT series, {_SQL_TS.format('ts')} AS ts, round((lp - avg(lp) OVER (PARTITION BY series)) / nullif(stddev_pop(lp) OVER (PARTITION BY series), 0), 6) AS z FROM x")
def normalised_log_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = A.hourly(spark, sf_dir).select("series", "ts", series.log_price("price").alias("lp"))
    return stats.standardised(x, ["series"], "lp", "z").select("series", _ts().alias("ts"), _r("z").alias("z"))


@_query()
def loess_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices less a local line through the nearest 169 hours."""
    x = series.loess(A.hourly(spark, sf_dir), ["series"], "ts", "price")
    return x.select("series", _ts().alias("ts"), (F.col("price") - F.col("trend")).alias("detrended"))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series.log_return("price", series.order(["series"], ["ts"]))
    return A.hourly(spark, sf_dir).select("series", "ts", r.alias("r")).where("r is not null")


@_query(f"WITH {A.H}, r AS (SELECT {_LP} - lag({_LP}) {_W} AS r FROM h), n AS (SELECT count(r) AS n FROM r) SELECT (CASE WHEN r < -6 THEN 0 WHEN r >= 6 THEN 121 ELSE floor((r + 6) / 0.1) + 1 END)::BIGINT AS bin, round(count(*) / (max(n) * 0.1), 6) AS density FROM r CROSS JOIN n WHERE r IS NOT NULL GROUP BY 1")
def return_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of log-returns in 120 bins from -6 to 6; what lies beyond is in bins of its own."""
    bins = stats.histogram(_returns(spark, sf_dir), F.col("r"), -6.0, 6.0, 120)
    return bins.select("bin", _r(F.col("n") / (F.sum("n").over(Window.partitionBy()) * 0.1)).alias("density"))  # over one row per bin


@_query()
def return_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each series' log-returns, and how well they lie on a normal plot."""
    r = _returns(spark, sf_dir)
    level = r.groupBy("series").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"))
    return stats.normal_plot(r, ["series"], "r").join(level, "series")


# --- regimes ------------------------------------------------------------------------------------------------------------------

_PRICED = f"{A.M}, {A.R}, {A.H}, p AS (SELECT ts, price FROM h WHERE series = 'purchase')"


@_query(f"WITH {_PRICED} SELECT {_SQL_TS.format('rg.ts')} AS ts, regime, round(price, 6) AS price FROM rg LEFT JOIN p USING (ts)")
def regime_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour's regime with the price of purchases then, if there was any."""
    return _regime_prices(spark, sf_dir).select(_ts().alias("ts"), "regime", _r("price").alias("price"))


def _regime_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = A.hourly(spark, sf_dir).where("series = 'purchase'").select("ts", "price")
    return A.regimes(spark, sf_dir).select("ts", "regime").join(price, "ts", "left")


@_query(f"WITH {A.M}, {A.R} SELECT {_SQL_TS.format('ts')} AS ts, regime, coalesce(regime <> lag(regime) OVER (ORDER BY ts), false) AS changed FROM rg")
def regime_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes in order of time, and where they change."""
    w = series.order(["series"], ["ts"])
    r = A.regimes(spark, sf_dir).withColumn("series", F.lit("all"))
    return r.select(_ts().alias("ts"), "regime", F.coalesce(F.col("regime") != F.lag("regime").over(w), F.lit(False)).alias("changed")).orderBy("ts")


@_query(
    f"WITH {_PRICED}, q0 AS (SELECT regime, price FROM rg JOIN p USING (ts) WHERE regime <> 'error'), t AS (SELECT quantile_cont(price, 0.99) AS top FROM q0), lo AS (SELECT regime, least(price, top) AS x FROM q0 CROSS JOIN t), q AS (SELECT regime, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75 FROM lo GROUP BY 1) "
    "SELECT regime, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(min(x), 4) AS low, round(max(x), 4) AS high FROM lo JOIN q USING (regime) WHERE x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) GROUP BY regime, q25, q50, q75"
)
def price_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by regime, clipped at their 99th percentile."""
    priced = _regime_prices(spark, sf_dir).where("regime <> 'error' and price is not null")
    top = stats.exact_percentiles(priced, [], "price", {"p99": 0.99}).first()  # one number
    clipped = priced.select("regime", F.least("price", F.lit(top.p99 if top else None)).alias("x"))
    return stats.box(clipped, ["regime"], "x").select("regime", *[_r(c, 4).alias(c) for c in ("q25", "q50", "q75", "low", "high")])


@_query(f"WITH {A.M}, {A.R} SELECT regime, {', '.join(f'round(100.0 * count(*) FILTER (month(ts) IN {m}) / greatest(count(*), 1), 2) AS {n}' for n, m in C._SEASONS.items())} FROM rg GROUP BY 1")
def season_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.month("ts")
    return A.regimes(spark, sf_dir).groupBy("regime").agg(*[_r(100.0 * F.count_if(m.isin(*x)) / F.greatest(F.count("*"), F.lit(1)), 2).alias(n) for n, x in C._SEASONS.items()])


_MAP = "m2 AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two places of each vector stand for a layout."""
    return A.table(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xy")])


@_query(f"WITH {_MAP} SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, event_type AS regime FROM m2 LEFT JOIN events ON event_id = vec_id")
def map_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.col("event_type").alias("regime"))
    return _map(spark, sf_dir).join(e, "vec_id", "left").select("vec_id", _r("x").alias("x"), _r("y").alias("y"), "regime")


@_query(f"WITH {_MAP} SELECT count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS noise FROM m2 LEFT JOIN events ON event_id = vec_id")
def map_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_by_regime(spark, sf_dir).agg(F.count("*").alias("n"), _r(F.avg((F.col("regime") == "error").cast("int"))).alias("noise"))


@_query(f"WITH {_MAP} SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM m2 JOIN orders ON o_orderkey = vec_id GROUP BY 1")
def map_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vec_id"), F.year("o_orderdate").alias("year"))
    return _map(spark, sf_dir).join(o, "vec_id").groupBy("year").agg(F.count("*").alias("n"), _r(F.avg("x")).alias("x"), _r(F.avg("y")).alias("y"))


@_query()
def stationary_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stationary distribution with its bootstrap interval, and the mean time in each label."""
    matrix = C._matrix(spark, sf_dir)
    both = markov.stationary_distribution(matrix).join(markov.bootstrap_stationary(matrix), "label")
    return both.join(markov.sojourn(matrix), "label")


@_query("WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS v FROM embeddings) SELECT count(*) AS n, round(quantile_cont(v, 0.99), 5) AS p99 FROM n")
def norm_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.table(spark, sf_dir, "embeddings").select(stats.norm("embedding").alias("v"))
    n = v.agg(F.count("*").alias("n"))
    return n.join(stats.exact_percentiles(v, [], "v", {"p99": 0.99})).select("n", _r("p99", 5).alias("p99"))  # one row each


@_query("WITH x AS (SELECT i AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)), v AS (SELECT dim, var_pop(x) AS variance FROM x GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY variance DESC, dim)::INT AS rank, sum(variance) OVER (ORDER BY variance DESC, dim) / sum(variance) OVER () AS cumulative FROM v) SELECT min(rank) FILTER (cumulative >= 0.9) AS n90, min(rank) FILTER (cumulative >= 0.95) AS n95 FROM c")
def variance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.components_for(stats.variance_rank(A.table(spark, sf_dir, "embeddings"), "embedding"), 0.9, 0.95)


@_query()
def tsne_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout of at most 3,000 vectors, drawn by a seed, in one task; of no rows if it fails."""

    def layout(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        try:
            y = cluster.tsne(np.array(pdf["embedding"].tolist(), float))
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            return pdf.iloc[:0].assign(x=0.0, y=0.0)[["vec_id", "x", "y"]]
        return pdf.assign(x=y[:, 0], y=y[:, 1])[["vec_id", "x", "y"]]

    some = stats.seeded_sample(A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", 3_000)
    return some.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: layout(pdf), "vec_id long, x double, y double")


# --- mode-seeking grid --------------------------------------------------------------------------------------------------------

_MODES = {"k": [5, 10, 15], "clusters": [5, 10]}


def _mode_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real trials over the embeddings, kept as they end, with the silhouettes of all points, found once for all of them."""
    from tempfile import mkdtemp

    points = spark.sparkContext.broadcast(C._points(spark, sf_dir)[1])
    near = spark.sparkContext.broadcast(cluster.shared_knn(spark, points, max(_MODES["k"])))  # all trials begin with these
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + mkdtemp(prefix="voltaic-")
    result = "k long, clusters long, n_found long, noise double, persistence double, labels binary, status string"

    def trial(k, clusters) -> dict:
        return cluster.mode_labels(points.value, int(k), int(clusters), near.value)

    kept = cluster.resumed_grid(cluster.grid(spark, **_MODES), f"{folder.rstrip('/')}/voltaic/grid-{uuid.uuid4().hex}", list(_MODES), trial, result)
    return cluster.scored_modes(kept, points, list(_MODES)).select(*_MODES, "n_found", "noise", "silhouette", "persistence", "status")


@_query()
def tomato_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.ranked(_mode_trials(spark, sf_dir), "silhouette", list(_MODES))


@_query()
def tomato_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silhouette of each pair of parameters; raises RuntimeError if a trial failed, so that a null is a trial without two clusters."""
    return cluster.heat_map(cluster.finished(_mode_trials(spark, sf_dir), list(_MODES)), "k", "clusters", "silhouette", _MODES["clusters"])


@_query()
def tomato_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all trials; raises RuntimeError if one failed, as it might be the best, or if none has a silhouette."""
    return cluster.best(cluster.finished(_mode_trials(spark, sf_dir), list(_MODES)), "silhouette", list(_MODES))


@_query()
def persistence_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each trial that found two clusters or more; raises RuntimeError if one failed."""
    found = cluster.finished(_mode_trials(spark, sf_dir), list(_MODES))
    return found.select("k", "clusters", "persistence", "silhouette").dropna(subset=["silhouette"])


# --- mean reversion and paths -------------------------------------------------------------------------------------------------


@_query(f"WITH {C._DRIFT}, {C._LONG}, {C._FIT}, t AS (SELECT series, horizon_h, CASE WHEN slope < 0 THEN ln(2) / (-slope / horizon_h) END AS hl FROM fit) SELECT series, {', '.join(f'round(max(hl) FILTER (horizon_h = {h}), 5) AS h{h}' for h in (1, 6, 24))} FROM t GROUP BY 1")
def half_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = meanrev.ou_parameters(C._fits(spark, sf_dir)).groupBy("series").pivot("horizon_h", [1, 6, 24]).agg(F.max("half_life"))
    return wide.select("series", *[_r(F.col(str(h)), 5).alias(f"h{h}") for h in (1, 6, 24)])


@_query(f"WITH {C._DRIFT}, {C._LONG}, {C._FIT} SELECT dr.series, {_SQL_TS.format('ts')} AS ts, round(lp, 6) AS log_price, round(d6, 6) AS drift_6h, round(intercept + slope * lp, 6) AS fitted FROM dr JOIN fit ON fit.series = dr.series AND horizon_h = 6 WHERE d6 IS NOT NULL")
def drift_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift over six hours against the price, with the fitted line."""
    fit = C._fits(spark, sf_dir).where("horizon_h = 6").select("series", "slope", "intercept")
    d = C._drift(spark, sf_dir).where("d6 is not null").join(F.broadcast(fit), "series")  # a row per series
    return d.select("series", _ts().alias("ts"), _r("lp").alias("log_price"), _r("d6").alias("drift_6h"), _r(F.col("intercept") + F.col("slope") * F.col("lp")).alias("fitted"))


@_query(f"WITH {C._DRIFT}, {C._LONG}, {C._FIT} SELECT series, horizon_h, r2 >= 0.05 AND ln(2) / (-slope / horizon_h) BETWEEN 1 AND 720 AS plausible FROM fit WHERE slope < 0")
def plausible_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meanrev.ou_parameters(C._fits(spark, sf_dir)).where("valid").select("series", "horizon_h", meanrev.plausible().alias("plausible"))


@_query(f"WITH {C._MC}, e AS (SELECT * FROM mc WHERE hour = 23), q AS (SELECT quantile_cont(y, 0.05) AS v FROM e) SELECT 23 AS hour, {', '.join(f'round(quantile_cont(y, {p}), 4) AS lmp_{n}' for n, p in (('q05', 0.05), ('q50', 0.5), ('q95', 0.95)))}, round(avg(y), 4) AS lmp_mean, round(stddev_pop(y), 4) AS lmp_std, round(max(v), 4) AS var_95, round(avg(y) FILTER (y <= v), 4) AS cvar_95 FROM e CROSS JOIN q")
def terminal_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = simulate.terminal(C._paths(spark, sf_dir), 23, "x", "hour")
    return t.select("hour", *[_r(c, 4).alias(c) for c in t.columns if c != "hour"])


@_query(f"WITH {C._MC}, e AS (SELECT y FROM mc WHERE hour = 23), q AS (SELECT quantile_cont(y, 0.99) AS top FROM e) SELECT (CASE WHEN y >= 400 THEN 81 ELSE floor(y / 5) + 1 END)::BIGINT AS bin, count(*) AS n FROM e CROSS JOIN q WHERE y <= top GROUP BY 1")
def terminal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the last hour up to their 99th percentile."""

    def through_log(x: float) -> float:  # by the C library, as DuckDB: Java's functions differ in the last bit, which puts a price of 5 on the other side of an edge
        return x if math.isnan(x) else math.exp(math.log(x))

    last = A.table(spark, sf_dir, "events").where(F.hour("ts") == 23)
    e = last.select(F.udf(through_log, "double", useArrow=False)(F.greatest("value", F.lit(series.FLOOR))).alias("y"))
    top = stats.exact_percentiles(e, [], "y", {"p99": 0.99}).first()  # one number
    return stats.histogram(e.where(F.col("y") <= F.lit(top.p99 if top else None)), F.col("y"), 0.0, 400.0, 80)


@_query()
def mc_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.terminal(C.mc_paths(spark, sf_dir), simulate.HOURS)


@_query()
def mc_sample_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty paths, drawn by a seed, with the median price of all paths at each hour."""
    paths = C.mc_paths(spark, sf_dir)
    drawn = stats.seeded_sample(paths.select("traj_id").distinct(), "traj_id", 50)
    median = stats.exact_percentiles(paths, ["hour"], "log_lmp", {"m": 0.5}).select("hour", F.exp("m").alias("median_lmp"))
    return paths.join(F.broadcast(drawn), "traj_id", "left_semi").join(F.broadcast(median), "hour").select("traj_id", "hour", F.exp("log_lmp").alias("lmp"), "median_lmp")


@_query()
def mc_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each simulated path, a column for each hour."""
    return simulate.wide(C.mc_paths(spark, sf_dir), simulate.HOURS)
