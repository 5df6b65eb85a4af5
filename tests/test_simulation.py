"""Simulated paths follow the fitted regimes."""

from __future__ import annotations

from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.operators import simulate
from voltaic.plans import catalog

SF = "/root/testdata/sf0.001"


def test_regimes_without_a_valid_fit_walk(spark):
    df = spark.createDataFrame([("a", 50.0, 40.0, 0.2, 3.0, True, 0.1), ("b", 50.0, 40.0, None, None, False, 0.1), ("c", 50.0, 0.0, None, None, None, None)], "label string, mean_lmp double, median_lmp double, theta double, mu double, valid boolean, sigma double")
    got = {r.label: (r.theta, r.mu, r.sigma) for r in simulate.with_fallback(df).collect()}
    assert got == {"a": (0.2, 3.0, 0.1), "b": pytest.approx((0.0, log(40), 1.0)), "c": pytest.approx((0.0, log(1e-3), 1.0))}


def test_paths_have_the_fits_of_their_regimes(spark):
    labels, ou, p, x0 = catalog._regimes(spark, SF)
    fits = {r.series: r for r in catalog.ou_params(spark, SF).where("horizon_h = 1 and valid").collect()}
    sigmas = {r.series: r.sigma for r in catalog.sigma_by_series(spark, SF).collect()}
    assert all((t, m, s) == pytest.approx((fits[x].theta, fits[x].mu, sigmas[x]), abs=2e-5) for x, (t, m, s) in zip(labels, ou) if x in fits)
    out = catalog.mc_paths(spark, SF)
    assert out.agg(F.count("*"), F.countDistinct("traj_id"), F.max("hour")).first() == (720_000, 1_000, 720)
    theta, mu, sigma = np.array(ou).T
    first = out.where("hour = 1").groupBy("regime").agg(F.stddev_pop("log_lmp").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s == pytest.approx(sigma[r.regime], rel=0.35) for r in first if r.n > 100)
    assert catalog.mc_paths_summary(spark, SF).count() == 720
    assert catalog.mc_paths_regimes(spark, SF).agg(F.sum("share")).first()[0] == pytest.approx(720)
