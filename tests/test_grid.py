"""Trials run over the points, within a time, and again when a connection is lost."""

from __future__ import annotations

import time

import numpy as np
import pytest

from voltaic.operators import cluster


def test_trials_time_out_and_are_tried_again(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def trial(a):
        if a == 1:
            time.sleep(60)
        if a == 2:
            with open(seen, "a") as f:
                f.write("x")
            if len(open(seen).read()) < 3:
                raise ConnectionError("lost")
        if a == 3:
            raise ConnectionError("gone")
        return {"score": float(a)}

    found = cluster.run_grid(cluster.grid(spark, a=[1, 2, 3, 4]), None, ["a"], trial, "a long, score double, status string", timeout=1, tries=3, wait=0.01).collect()
    assert {r.a: (r.score, r.status) for r in found} == {1: (None, "error: over 1 s"), 2: (2.0, "ok"), 3: (None, "error: gone"), 4: (4.0, "ok")}


def test_a_grid_resumes_from_what_is_kept(spark, tmp_path):
    path, seen = f"file://{tmp_path}/kept", str(tmp_path / "seen")

    def trial(a):
        with open(seen, "a") as f:
            f.write("x")
        if a == 2 and len(open(seen).read()) <= 3:
            raise ValueError("not yet")
        return {"score": float(a)}

    run = lambda values: {r.a: (r.score, r.status) for r in cluster.resumed_grid(cluster.grid(spark, a=values), path, ["a"], trial, "a long, score double, status string", batch=2).collect()}
    assert run([1, 2, 3]) == {1: (1.0, "ok"), 2: (None, "error: not yet"), 3: (3.0, "ok")} and len(open(seen).read()) == 3
    assert run([1, 2, 3, 4]) == {a: (float(a), "ok") for a in (1, 2, 3, 4)} and len(open(seen).read()) == 5


def test_ranks_and_heat_maps(spark):
    df = spark.createDataFrame([(5, 10, None), (5, 20, 0.3), (10, 10, 0.5), (10, 10, 0.1)], "k long, size long, score double")
    assert [r.score for r in cluster.ranked(df, "score", ["k", "size"]).orderBy("rank").collect()] == [0.5, 0.3, 0.1, None]
    assert cluster.best(df, "score", ["k", "size"]).first().k == 10
    with pytest.raises(RuntimeError):
        cluster.best(df.where("score is null"), "score", ["k", "size"])
    assert sorted(map(tuple, cluster.heat_map(df, "k", "size", "score", [10, 20, 30]).collect())) == [(5, None, 0.3, None), (10, 0.5, None, None)]


def planted():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.05, (40, 4)) for c in (0, 5, 10)]), np.repeat([0, 1, 2], 40)


def same(a, b):
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


def test_planted_clusters_are_found():
    x, truth = planted()
    far = np.concatenate([x, [[40.0] * 4]])
    labels = cluster.hdbscan(far, 10)
    assert labels[-1] == -1 and same(labels[:-1], truth)
    for k, n in ((5, 3), (10, 3), (30, 2)):
        assert same(cluster.tomato(x, k, n)[0], truth)
    good = cluster.relative_validity(cluster.spanning_tree(x, 10), truth)
    assert good > 0.8 > cluster.relative_validity(cluster.spanning_tree(x, 10), np.arange(120) % 3)
    assert cluster.relative_validity([], np.zeros(5, int)) is None


def test_layouts_keep_neighbours_together():
    x, truth = planted()
    assert cluster.layout_curve(0.1) == pytest.approx((1.577, 0.895), abs=2e-3)
    head, tail, w = cluster.fuzzy_graph(x, 10)
    pairs = {(i, j): v for i, j, v in zip(head.tolist(), tail.tolist(), w.tolist())}
    assert all(0 < v <= 1 + 1e-9 and pairs[j, i] == pytest.approx(v) for (i, j), v in pairs.items())
    for y in (cluster.umap(x, 10, 0.1), cluster.umap(x, 10, 0.0, 20), cluster.tsne(x, 20, 300)):
        near = np.argsort(((y[:, None] - y) ** 2).sum(axis=2), axis=1)[:, 1:6]
        assert (truth[near] == truth[:, None]).mean() > 0.95


def test_blocks_give_the_whole(spark, monkeypatch):
    x, truth = planted()
    truth = np.where(np.arange(120) % 17 == 0, -1, truth)
    df = spark.createDataFrame([(i, [float(v) for v in p], int(t)) for i, (p, t) in enumerate(zip(x, truth))], "vec_id long, embedding array<double>, label int").repartition(3)
    at, dist = cluster.knn(x, 4)
    for rows in (20_000, 30):
        monkeypatch.setattr(cluster, "BLOCK_ROWS", rows)
        assert cluster.mean_silhouette(df).first().silhouette == pytest.approx(cluster.silhouette(x, truth))
        got = cluster.neighbours(df, 4).orderBy("vec_id", "rank").collect()
        assert [r.other for r in got] == at.ravel().tolist() and [r.distance for r in got] == pytest.approx(dist.ravel().tolist(), abs=1e-6)


def test_components_and_periods_are_numpys(spark):
    x, _ = planted()
    df = spark.createDataFrame([([float(v) for v in p],) for p in x], "embedding array<double>")
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert cluster.pca_components(df, share=0.9) == int(np.searchsorted(np.cumsum(s / s.sum()), 0.9) + 1)
    reduced = np.array([r.reduced for r in cluster.pca(df, 2).collect()])
    assert reduced.var(axis=0) == pytest.approx((s / len(x))[:2])


def test_a_trial_scores_the_points():
    rng = np.random.default_rng(0)
    apart = np.concatenate([rng.normal(c, 0.05, (40, 4)) for c in (0, 5, 10)])
    got = cluster.layout_trial(apart, 10, 0.1, 10)
    assert got["n_clusters"] == 3 and got["noise"] < 0.05 and got["silhouette"] > 0.5
    assert cluster.layout_trial(rng.normal(0, 1, (120, 4)), 10, 0.1, 10)["validity"] < 0.5 < got["validity"]
