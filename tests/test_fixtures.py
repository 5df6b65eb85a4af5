"""Small literal inputs with results derived by hand."""

from __future__ import annotations

from datetime import datetime
from math import log, sqrt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.functions import features, ilr
from voltaic.operators import clean, cluster, markov, meanrev, series, simulate, stats
from voltaic.plans import catalog
from voltaic.sources import market


def test_tagged_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("C,x\nH,Date,Hour Ending\nH,String,Number\nD,01/02/2021,01\nD,01/02/2021\n")
    found = market.read_tagged(spark, str(tmp_path), ["Date", "Hour Ending", "Absent"]).drop("file").collect()
    assert sorted(map(tuple, found)) == [("01/02/2021", "", None), ("01/02/2021", "01", None)]


def test_quoted_cells_and_files_without_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('H,"Name, full",B\nD,"x, ""y""", z \nD,p,q,r\nX,1,2\n')
    (tmp_path / "b.csv").write_text("C,only\nD,1,2\n")
    found = market.read_tagged(spark, str(tmp_path), ["Name, full", "B"]).drop("file").collect()
    assert sorted(map(tuple, found)) == [("p", "q"), ('x, "y"', "z")]


def fake_pages(name, offset, size):
    if name == "broken" and offset:
        raise OSError("gone")
    return [(name, offset + i) for i in range(min(size, 7 - offset) if name != "broken" else size)]


def test_pages_end_short_or_broken(spark):
    rows = market.read_paged(spark, ["wind", "broken"], fake_pages, "name string, at long", size=3).collect()
    assert sorted(map(tuple, rows)) == [("broken", i) for i in range(3)] + [("wind", i) for i in range(7)]


def test_csv_json_and_purge(spark, tmp_path):
    path = str(tmp_path / "results")
    market.write_csv(spark.createDataFrame([(1, 0.5), (2, None)], "a long, score double"), path)
    assert sorted(map(tuple, market.read_results(spark, path, "a long, score double").collect())) == [(1, 0.5), (2, None)]
    market.write_json_row(spark.createDataFrame([(1, 0.5)], "a long, score double"), str(tmp_path / "best"))
    assert spark.read.json(str(tmp_path / "best")).first().asDict() == {"a": 1, "score": 0.5}
    market.purge(spark, path, str(tmp_path / "absent"))
    assert not market.exists(spark, path) and market.exists(spark, str(tmp_path / "best"))


def test_concat_by_name(spark):
    one, two = spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([("y", 2.0)], "b string, c double")
    assert sorted(map(tuple, market.concat(one, two).collect()), key=str) == [(1, "x", None), (None, "y", 2.0)]


def test_missing_and_infinite_values(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 1.0, 2.0), (4, float("nan"), 2.0)], "i long, a double, b double")
    assert [r.i for r in clean.complete(df, ["a", "b"]).collect()] == [3]
    assert sorted(r.i for r in df.where(~clean.all_null(["a", "b"])).collect()) == [1, 3, 4]
    assert {r.column: r.nulls for r in clean.null_counts(df, ["a", "b"]).collect()} == {"a": 1, "b": 2}
    bad = spark.createDataFrame([([1.0, float("inf")],), ([1.0, 2.0],), (None,)], "v array<double>")
    with pytest.raises(ValueError, match="2 rows"):
        clean.require_finite(bad, "v")
    assert clean.require_finite(bad.limit(0), "v").count() == 0


def test_columns_by_prefix(spark):
    df = spark.createDataFrame([(7, *map(float, range(11)))], ["i", *(f"emb_{k}" for k in range(11))])
    (row,) = clean.gathered(df, "emb_", "v").collect()
    assert row.i == 7 and row.v == list(map(float, range(11)))
    assert clean.spread(clean.gathered(df, "emb_", "v"), "v", "emb_", 11).first() == df.first()


def test_channels_must_divide(spark):
    df = spark.createDataFrame([([1.0] * 6,), ([1.0] * 5,)], "v array<double>")
    assert [r[0] for r in df.select(stats.channels("v", 3, 2)).collect()] == [[[1.0, 1.0]] * 3, None]


def test_active_features():
    assert features.active({"log_return": True, "hour_cyclical": True}, {"ilr_1": False, "ilr_2": True}) == ["log_return", "hour_sin", "hour_cos", "ilr_2"]


def test_domain_partition(spark):
    parts = [0.3, 0.2, 0.1, 0.1, 0.05, 0.02, 0.01, 0.22]
    z = np.array(spark.createDataFrame([tuple(parts)], ilr.PARTS).select(*ilr.forward(ilr.PARTS, ilr.PARTITION)).first())
    assert z[3] == pytest.approx(sqrt(0.5) * log(2)) and z[6] == pytest.approx(sqrt(0.5) * log(0.5))
    basis = np.array(ilr.basis(ilr.PARTITION))
    assert np.abs(basis @ basis.T - np.eye(7)).max() < 1e-12 and z == pytest.approx(basis @ np.log(parts))


def hours(spark, rows, schema):
    start = F.lit("2021-01-01").cast("timestamp_ntz")
    return spark.createDataFrame(rows, schema).withColumn("ts", start + F.make_dt_interval(F.lit(0), F.col("h").cast("int")))


def test_windows_keep_nulls_in_place(spark):
    df = hours(spark, [("a", i, None if i == 3 else float(i), i) for i in range(8)] + [("b", i, 1.0, i) for i in range(3)], "s string, h long, x double, y long")
    got = {r.end_ts.hour: (r.x, r.y) for r in series.windows_of(df, ["s"], "ts", ["x", "y"], 4, 2).collect()}
    assert got == {3: ([0, 1, 2, None], [0, 1, 2, 3]), 5: ([2, None, 4, 5], [2, 3, 4, 5]), 7: ([4, 5, 6, 7], [4, 5, 6, 7])}
    assert series.windows_of(df, ["s"], "ts", ["x"], 2, 3).count() == 3 + 1  # strides beyond the length


def test_contexts(spark):
    df = hours(spark, [("a", i, None if i == 6 else float(i)) for i in range(12)], "s string, h long, x double")
    ends = hours(spark, [("a", h) for h in (1, 2, 3, 5, 6, 9, 40)], "s string, h long").drop("h")
    got = {r.ts.hour: r.history for r in series.contexts(ends, df, ["s"], "ts", "x", 3).collect()}
    assert got == {3: [1, 2, 3], 5: [3, 4, 5], 9: [7, 8, 9]}
    assert 2 in {r.ts.hour for r in series.contexts(ends, df, ["s"], "ts", "x", 3, skip_first=False).collect()}


def test_halves(spark):
    df = hours(spark, [("a", i) for i in range(5)] + [("b", 0)], "s string, h long")
    assert sorted((r.s, r.h, r.half) for r in series.halves(df, ["s"], ["ts"]).collect()) == [("a", 0, 1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 2), ("a", 4, 2), ("b", 0, 2)]


def test_correlogram_over_blocks(spark):
    x = np.sin(np.arange(500) / 7) + np.random.default_rng(0).normal(0, 0.3, 500)
    df = hours(spark, [("a", i, float(v)) for i, v in enumerate(x)], "s string, h long, x double")
    c = x - x.mean()
    expected = [float((c[:-k] * c[k:]).sum() / (c * c).sum()) for k in range(1, 31)]
    for block in (32, 64, 4_096):
        got = {r.lag: r.acf for r in series.correlogram(df, ["s"], "ts", "x", 30, block).collect()}
        assert [got[k] for k in range(1, 31)] == pytest.approx(expected)


def test_loess_follows_a_line(spark):
    df = hours(spark, [("a", i, 3.0 + 0.5 * i) for i in range(120)] + [("b", 0, 1.0)], "s string, h long, x double")
    whole = {(r.s, r.ts): r.trend for r in series.loess(df, ["s"], "ts", "x", 21, 4_096).collect()}
    assert sorted(whole.values()) == pytest.approx(sorted([1.0, *(3.0 + 0.5 * i for i in range(120))]))
    assert {(r.s, r.ts): r.trend for r in series.loess(df, ["s"], "ts", "x", 21, 16).collect()} == pytest.approx(whole)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(0, 50, 400).tolist(), "b": [1.0] * 7 + [2.0], "c": [-0.0, 0.0, 1e-320, 5e-324], "d": np.exp(rng.normal(0, 20, 100)).tolist()}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)], "k string, x double")
    at = {"lo": 0.0, "p05": 0.05, "p37": 0.37, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    got = {r.k: r for r in stats.exact_percentiles(df, ["k"], "x", at).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert [got[k][n] for n in at] == pytest.approx(np.percentile(v, [100 * p for p in at.values()]).tolist(), rel=1e-9, abs=1e-12)
    (whole,) = stats.exact_percentiles(df.where("k = 'a'"), [], "x", {"mid": 0.5}).collect()
    assert whole.mid == pytest.approx(np.median(values["a"]))


def test_normal_plot_and_samples(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("n", float(x)) for x in rng.normal(3, 2, 500)] + [("e", float(x)) for x in rng.exponential(1, 500)], "k string, x double")
    got = {r.k: r.r2 for r in stats.normal_plot(df, ["k"], "x").collect()}
    assert got["n"] > 0.99 > 0.9 > got["e"]
    ids = spark.range(100)
    one, two = ([r.id for r in stats.seeded_sample(t, "id", 10).collect()] for t in (ids, ids.repartition(7)))
    assert sorted(one) == sorted(two) and len(set(one)) == 10


def test_p_values_and_errors_of_slopes(spark):
    # Student's t with 8 degrees of freedom: P(|t| > 2.306) = 0.05, P(|t| > 3.355) = 0.01.
    for t, p in ((2.306004, 0.05), (3.355387, 0.01)):
        assert meanrev.slope_p_value(t * t / (t * t + 8), 10) == pytest.approx(p, rel=1e-4)
    x, y = np.arange(12.0), np.arange(12.0) * 0.5 + np.random.default_rng(1).normal(0, 1, 12)
    (row,) = meanrev.ols(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double"), ["k"], "x", "y").collect()
    slope, level = np.polyfit(x, y, 1)
    left = y - slope * x - level
    assert (row.slope, row.r, row.stderr) == pytest.approx((slope, np.corrcoef(x, y)[0, 1], sqrt((left**2).sum() / 10 / ((x - x.mean()) ** 2).sum())))
    assert [r[0] for r in spark.createDataFrame([(0.06, 10.0), (0.04, 10.0), (0.5, 0.5)], "r2 double, half_life double").select(meanrev.plausible()).collect()] == [True, False, False]


def test_forecast_repeats_the_season():
    day = np.arange(24.0)
    past = np.vstack([np.tile(day, 3), np.tile(day, 3) + 1])
    assert meanrev.seasonal_forecast(past, 30)[0].tolist() == [*day, *day[:6]] and meanrev.seasonal_forecast(past[:, :5], 3).tolist() == [[0, 0, 0]] * 2


def test_bootstrap_lies_around_the_distribution(spark):
    pairs = spark.createDataFrame([("a", "a")] * 90 + [("a", "b")] * 10 + [("b", "a")] * 30 + [("b", "b")] * 70, "from_label string, to_label string")
    matrix = markov.transition_matrix(pairs, spark.createDataFrame([("a",), ("b",)], "label string"))
    got = {r.label: r for r in markov.bootstrap_stationary(matrix, 400).collect()}
    assert got["a"].lo < 0.75 < got["a"].hi and got["a"].mean == pytest.approx(0.75, abs=0.03) and got["a"].hi - got["a"].lo < 0.25


def test_paths_without_noise(spark):
    one = np.ones(1)
    x, regime = simulate.chunk_paths(np.random.default_rng(0), 3, 8, 0.0, one, np.ones((1, 1)), one * 0.5, one, one * 0)
    assert x[1].tolist() == pytest.approx([1 - 0.5**n for n in range(1, 9)]) and regime.shape == (3, 2) and not regime.any()
    p = np.array([[0.9, 0.1], [0.3, 0.7]])
    _, regime = simulate.chunk_paths(np.random.default_rng(1), 4_000, 60, 0.0, np.array([0.75, 0.25]), p, np.zeros(2), np.zeros(2), np.ones(2))
    assert (regime == 0).mean(axis=0) == pytest.approx(np.full(10, 0.75), abs=0.03)
    wide = simulate.wide(spark.createDataFrame([(1, 1, 0.5), (1, 2, 1.5)], "traj_id long, hour long, log_lmp double"), 2)
    assert wide.columns == ["traj_id", "h001", "h002"] and tuple(wide.first()) == (1, 0.5, 1.5)


def test_hub_and_fallback(spark):
    rows = [("f", "A", "HUB"), ("f", "B", "ZONE"), ("g", "A", "HUB"), ("g", "C", "ZONE")]
    df = spark.createDataFrame(rows, ["file", "Location Name", "Location Type"])
    assert sorted(map(tuple, market.hub_rows(df, "B").collect())) == [("f", "B", "ZONE"), ("g", "A", "HUB")]


def test_records(spark, tmp_path):
    for page, value in (("0", "10"), ("1", "20")):
        (tmp_path / f"{page}.json").write_text(f'{{"response": {{"data": [{{"period": "2021-11-07T0{5 + int(page)}", "fueltype": "WND", "value": "{value}"}}]}}}}')
    df = market.read_records(spark, str(tmp_path), {"WND": "wind"})
    hours = clean.pivot_sum(df.select(clean.local_hour("period").alias("ts"), "fueltype", clean.number("value").alias("value")), ["ts"], "fueltype", "value", ["wind", "coal"])
    (row,) = clean.with_shares(hours, ["wind", "coal"]).collect()
    assert (str(row.ts), row.wind, row.coal, row.total, row.wind_share) == ("2021-11-07 01:00:00", 30, 0, 30, 1)


def test_sinks_and_skipping(spark, tmp_path):
    path = str(tmp_path / "trials")
    for k in (1, 2):
        market.append_results(spark.range(k, k + 1), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for fresh in (False, False, True):
        assert market.materialised(spark, str(tmp_path / "once"), make, fresh).count() == 3
    assert len(made) == 2


def test_hour_ending(spark):
    df = spark.createDataFrame([("01/02/2021", "01"), ("01/02/2021", "24"), ("11/07/2021", "02X")], ["d", "h"])
    found = [str(r[0]) for r in df.select(clean.hour_start("d", "h")).collect()]
    assert found == ["2021-01-02 00:00:00", "2021-01-02 23:00:00", "2021-11-06 23:00:00"]


def test_shares_of_nothing_are_null(spark):
    (row,) = clean.with_shares(spark.createDataFrame([(0.0, 0.0)], ["a", "b"]), ["a", "b"]).collect()
    assert row.a_share is None and row.b_share is None


def test_range_ends_at_midnight(spark):
    df = spark.sql("select explode(array(timestamp_ntz'2025-12-31 00:00', timestamp_ntz'2025-12-31 01:00')) ts")
    assert df.where(clean.within("ts", "2025-01-01", "2025-12-31")).count() == 1


def test_duplicates_then_negatives(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 2, -1.0)], ["hour", "ord", "solar"])
    kept, removed = clean.clean(df, ["hour"], ["ord"], ["solar"])
    assert [r.ord for r in kept.collect()] == [0]
    assert sorted((r.ord, r.reason) for r in removed.collect()) == [(1, "duplicate"), (2, "negative")]


def test_gaps(spark):
    df = spark.createDataFrame([(h,) for h in (0, 1, 3, 4, 7)], "h int").select((F.lit("2021-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), "h")).alias("ts"))
    (row,) = clean.gaps(df, "ts").collect()
    assert (row.from_ts.hour, row.to_ts.hour, row.gap_hours) == (4, 7, 3)


def test_log_ratios(spark):
    signs = ilr.chain_partition(8)
    names = [f"s{i}" for i in range(8)]
    parts = np.random.default_rng(1).dirichlet(np.ones(8), 20)
    df = spark.createDataFrame([tuple(map(float, p)) for p in [*parts, np.full(8, 1 / 8)]], names)
    z = df.select(*names, *[c.alias(f"z{i}") for i, c in enumerate(ilr.forward([F.col(n) for n in names], signs))])
    back = z.select(*names, *[f"z{i}" for i in range(7)], *[c.alias(f"b{i}") for i, c in enumerate(ilr.inverse([F.col(f"z{i}") for i in range(7)], signs))])
    found = np.array(back.collect(), float)
    assert np.abs(found[:, :8] - found[:, 15:]).max() < 1e-10
    assert np.abs(found[-1, 8:15]).max() < 1e-12


@pytest.mark.parametrize(("slope", "intercept", "horizon"), [(-0.1, 0.5, 1), (-0.6, 3.0, 6)])
def test_mean_reversion(spark, slope, intercept, horizon):
    df = spark.createDataFrame([(horizon, float(x), intercept + slope * x) for x in range(12)], ["horizon_h", "x", "y"])
    (row,) = meanrev.ou_parameters(meanrev.ols(df, ["horizon_h"], "x", "y")).collect()
    assert (row.theta, row.mu, row.half_life, row.r2) == pytest.approx((0.1, 5, 10 * log(2), 1)) and row.valid
    (up,) = meanrev.ou_parameters(meanrev.ols(df.withColumn("y", -F.col("y")), ["horizon_h"], "x", "y")).collect()
    assert (up.theta, up.mu, up.half_life, up.valid) == (None, None, None, False)
    assert meanrev.ols(df.limit(9), ["horizon_h"], "x", "y").count() == 0


def test_stationary_distribution():
    assert markov.stationary(np.array([[0.9, 0.1], [0.3, 0.7]])) == pytest.approx([0.75, 0.25])


def test_hourly_summary(spark):
    df = spark.createDataFrame([(1, log(x)) for x in (1, 2, 3, 4, 5)], ["hour", "log_lmp"])
    (row,) = simulate.summary(df).collect()
    assert (row.lmp_q05, row.cvar_95, row.lmp_mean, row.lmp_std) == pytest.approx((1.2, 1.0, 3.0, sqrt(2)))


def test_noise_gate(spark):
    df = spark.createDataFrame([(0.4, 0.05), (0.4, 0.051)], ["score", "noise"])
    assert [r[0] for r in df.select(cluster.gated(F.col("score"), F.col("noise"))).collect()] == [0.4, None]


def test_grid_resumes(spark):
    todo = cluster.grid(spark, a=[1, 2, 3], b=[0.1, 0.2])

    def trial(a, b):
        if a == 3:
            raise ValueError("no")
        return {"score": float(a * b)}

    done = spark.createDataFrame([(1, 0.1)], ["a", "b"])
    found = cluster.run_grid(todo, done, ["a", "b"], trial, "a long, b double, score double, status string").collect()
    assert len(found) == 5 and sorted({r.status for r in found}) == ["error: no", "ok"]
    assert cluster.run_grid(todo, todo, ["a", "b"], trial, "a long, b double, score double, status string").count() == 0


def test_prices_on_an_edge_are_in_the_bin_of_the_sql(spark, tmp_path):
    at = datetime(2024, 1, 1, 23)
    values = [5.0 * k for k in range(1, 90)] + [7.0] * 20 + [0.0, -1.0, None]
    df = spark.createDataFrame([(i, at, i, "view", v) for i, v in enumerate(values)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = catalog.queries()["terminal_histogram"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(duck.sql(catalog.oracle_sql()["terminal_histogram"]).fetchall())
