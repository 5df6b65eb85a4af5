"""What a trial holds at once doesn't grow with the square of its points, and its results are those of the plain way."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from voltaic.operators import cluster


def peak_mb(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def plain_knn(x, k):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(d, at, axis=1)


def test_neighbours_hold_tiles():
    x = np.random.default_rng(0).normal(0, 1, (16_000, 4))
    assert peak_mb(lambda: cluster.knn(x, 5)) < 150  # 2,262 MB with blocks of whole rows


def test_neighbours_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    copies = np.repeat(rng.normal(0, 1, (40, 6)), 5, axis=0)
    for x in (rng.normal(0, 1, (300, 6)), 1e6 + rng.normal(0, 1, (300, 3)), copies, rng.integers(0, 3, (300, 3)).astype(float)):
        for tile in (4_096, 16):
            monkeypatch.setattr(cluster, "TILE_COLUMNS", tile)
            at, dist = plain_knn(x, 7)
            got_at, got_dist = cluster.knn(x, 7)
            assert (got_at == at).all() and (got_dist == dist).all()
            part = cluster.knn(x, 7, 50, 90)
            assert (part[0] == at[50:90]).all() and (part[1] == dist[50:90]).all()


def plain_tree(x, least):
    core = plain_knn(x, least)[1][:, -1]
    inside, best, link, edges, cur = np.zeros(len(x), bool), np.full(len(x), np.inf), np.zeros(len(x), int), [], 0
    for _ in range(len(x) - 1):
        inside[cur] = True
        d = np.maximum(np.sqrt(((x - x[cur]) ** 2).sum(axis=1)), np.maximum(core, core[cur]))
        better = ~inside & (d < best)
        best[better], link[better] = d[better], cur
        cur = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[cur]), int(link[cur]), cur))
    return sorted(edges)


def test_trees_hold_tiles():
    x = np.random.default_rng(0).normal(0, 1, (16_000, 4))
    assert peak_mb(lambda: cluster.spanning_tree(x, 10)) < 150  # 2,262 MB for the nearest five alone with blocks of whole rows


def test_trees_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    for x in (rng.normal(0, 1, (400, 5)), np.repeat(rng.normal(0, 1, (40, 4)), 8, axis=0), 1e6 + rng.normal(0, 1, (300, 3)), rng.integers(0, 4, (300, 3)).astype(float)):
        assert cluster.spanning_tree(x, 6) == plain_tree(x, 6)
        assert (cluster.hdbscan(x, 6) == cluster.hdbscan(x, 6, plain_tree(x, 6))).all()


def test_moves_are_held_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (6_000, 4))
    assert peak_mb(lambda: cluster.umap(x, 30, 0.1, 20, epochs=3)) < 70  # 101 MB with all moves of an epoch at once
    x = np.concatenate([rng.normal(c, 0.1, (60, 4)) for c in (0, 5)])
    whole = cluster.umap(x, 10, 0.1, epochs=4)
    assert (whole == cluster.umap(x, 10, 0.1, epochs=4, near=cluster.knn(x, 20))).all()
    monkeypatch.setattr(cluster, "MOVES", 300)
    assert np.allclose(whole, cluster.umap(x, 10, 0.1, epochs=4), rtol=0, atol=1e-9)


def test_slices_give_the_whole(spark, monkeypatch):
    x = np.random.default_rng(4).normal(0, 1, (500, 4))
    monkeypatch.setattr(cluster, "SLICE_ROWS", 70)
    at, dist = cluster.shared_knn(spark, spark.sparkContext.broadcast(x), 15)
    whole = cluster.knn(x, 15)
    assert (at == whole[0]).all() and (dist == whole[1]).all()
    for k in (5, 15):
        assert cluster.mode_trial(x, k, 5, near=(at, dist)) == cluster.mode_trial(x, k, 5)


def test_scores_hold_tiles():
    x = np.random.default_rng(5).normal(0, 1, (16_000, 4))
    assert peak_mb(lambda: cluster.silhouette(x, np.arange(16_000) % 400)) < 150  # 563 MB for 20,000 points with blocks of whole rows
    few, labels = x[:600], np.arange(600) % 7 - 1
    d = np.sqrt(((few[:, None] - few) ** 2).sum(axis=2))[labels != -1][:, labels != -1]
    own = labels[labels != -1]
    a = np.array([d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1) for i in range(len(own))])
    b = np.array([min(d[i, own == c].mean() for c in range(6) if c != own[i]) for i in range(len(own))])
    assert cluster.silhouette(few, labels) == pytest.approx(((b - a) / np.maximum(a, b)).mean())


def test_trials_share_a_layout(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def begin(a):
        with open(seen, "a") as f:
            f.write("x")
        if a == 3:
            raise ValueError("no layout")
        return a * 10

    def trial(a, b, begun):
        if b == 2:
            raise ValueError("no trial")
        return {"score": float(begun + b)}

    result = "a long, b long, score double, status string"
    found = cluster.run_grid(cluster.grid(spark, a=[1, 3], b=[1, 2]), None, ["a", "b"], trial, result, shared=["a"], begin=begin).collect()
    assert {(r.a, r.b): (r.score, r.status) for r in found} == {(1, 1): (11.0, "ok"), (1, 2): (None, "error: no trial"), (3, 1): (None, "error: no layout"), (3, 2): (None, "error: no layout")}
    assert open(seen).read() == "xx"


def test_a_shared_layout_scores_as_its_own():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.05, (60, 4)) for c in (0, 5, 10)])
    begun = cluster.trial_layout(x, 10, 0.1, 40, near=cluster.knn(x, 30))
    for least in (10, 20, 40):
        y = cluster.umap(x, 10, 0.1, 4, epochs=100)
        labels = cluster.hdbscan(y, least)
        got = cluster.layout_score(*begun, least)
        assert got["silhouette"] == cluster.silhouette(y, labels) and got["validity"] == cluster.relative_validity(cluster.spanning_tree(y, least), labels)
        assert got == cluster.layout_trial(x, 10, 0.1, least)
