"""The mode-seeking grid scores all points, and a trial that failed isn't passed over."""

from __future__ import annotations

import numpy as np
import pytest

from voltaic.operators import cluster
from voltaic.plans import figures


def planted(n):
    rng = np.random.default_rng(0)
    return rng.normal(0, 0.5, (n, 3)) + np.arange(n)[:, None] % 12


def stored(spark, folder, x):
    rows = [(i, [float(v) for v in p], i % 12) for i, p in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"file://{folder}/embeddings.parquet")
    return f"file://{folder}"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """More points than were drawn for a silhouette before, and the silhouettes of all of them by trial."""
    x = planted(3_600).astype(np.float32).astype(float)
    folder = stored(spark, tmp_path_factory.mktemp("many"), x)
    return folder, {(k, c): cluster.silhouette(x, cluster.tomato(x, k, c)[0]) for k in (5, 10, 15) for c in (5, 10)}


@pytest.fixture
def trials(spark, monkeypatch):
    """Puts literal trials in place of the grid's: one with a single cluster, one without a persistence and, unless left out, one that failed."""

    def put(failed: bool) -> None:
        rows = [(5, 5, 5, 0.0, 0.4, 0.1, "ok"), (10, 5, 1, 0.0, None, 0.2, "ok"), (10, 10, 10, 0.0, 0.3, None, "ok")] + failed * [(5, 10, None, None, None, None, "error: over 480 s")]
        schema = "k long, clusters long, n_found long, noise double, silhouette double, persistence double, status string"
        monkeypatch.setattr(figures, "_mode_trials", lambda *_: spark.createDataFrame(rows, schema))

    return put


def test_silhouettes_of_labellings_are_those_of_each(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([1e3 + planted(400), 1e3 + planted(40)])
    some = np.arange(440) // 44
    labels = np.stack([some, some // 2, rng.integers(0, 90, 440), np.where(np.arange(440) == 7, 1, 0), np.zeros(440, int), np.arange(440)]).astype(np.int32)
    want = [cluster.silhouette(x - 1e3, row) for row in labels]
    assert want[4:] == [None, None]
    for columns, rows in ((4_096, 2_048), (32, 70)):
        monkeypatch.setattr(cluster, "TILE_COLUMNS", columns)
        monkeypatch.setattr(cluster, "SLICE_ROWS", rows)
        got = cluster.shared_silhouettes(spark, spark.sparkContext.broadcast(x), labels)
        assert got[:4] == pytest.approx(want[:4]) and got[4:] == [None, None]
        parts = np.sum([cluster.silhouette_sums(x, labels[:4], i, i + rows) for i in range(0, 440, rows)], axis=0) / 440
        assert parts.tolist() == pytest.approx(want[:4])
    assert cluster.shared_silhouettes(spark, spark.sparkContext.broadcast(x), labels[:0]) == []


def test_a_trial_of_what_is_not_a_number_fails(spark, tmp_path):
    x = planted(60)
    x[3, 1] = np.nan
    with pytest.raises(ValueError, match="1 points"):
        cluster.mode_trial(x, 5, 5)
    folder = stored(spark, tmp_path, x)
    found = figures.tomato_grid(spark, folder).collect()  # status ok and no silhouette before
    assert len(found) == 6 and all(r.status.startswith("error: 1 points") and r.silhouette is None and r.n_found is None for r in found)
    with pytest.raises(RuntimeError, match="6 trials failed"):
        figures.persistence_silhouette(spark, folder)  # no rows before


def test_persistences_are_of_all_trials(spark, many, trials):
    folder, want = many
    assert {(r.k, r.clusters): r.silhouette for r in figures.persistence_silhouette(spark, folder).collect()} == pytest.approx(want)
    trials(failed=True)
    with pytest.raises(RuntimeError, match="1 trials failed.*over 480 s"):
        figures.persistence_silhouette(spark, "")  # the rows of the others before
    trials(failed=False)
    assert sorted(map(tuple, figures.persistence_silhouette(spark, "").collect())) == [(5, 5, 0.1, 0.4), (10, 10, None, 0.3)]


def test_the_best_is_of_all_trials_and_points(spark, many, trials):
    folder, want = many
    got = figures.tomato_best(spark, folder).first()
    assert (got.k, got.clusters) == max(want, key=want.get) and got.silhouette == pytest.approx(max(want.values()))
    trials(failed=True)
    with pytest.raises(RuntimeError, match="1 trials failed.*over 480 s"):
        figures.tomato_best(spark, "")  # the best of the others before
    trials(failed=False)
    assert figures.tomato_best(spark, "").first().silhouette == 0.4


def test_the_grid_scores_all_points_and_shows_what_failed(spark, many, trials):
    folder, want = many
    got = figures.tomato_grid(spark, folder).orderBy("rank").collect()
    assert {(r.k, r.clusters): r.silhouette for r in got} == pytest.approx(want)
    assert [(r.k, r.clusters) for r in got] == sorted(want, key=want.get, reverse=True) and all(r.status == "ok" and r.n_found >= 2 for r in got)
    trials(failed=True)
    assert [(r.k, r.clusters, r.silhouette) for r in figures.tomato_grid(spark, "").orderBy("rank").collect()] == [(5, 5, 0.4), (10, 10, 0.3), (5, 10, None), (10, 5, None)]


def test_the_heat_map_is_of_all_trials_and_points(spark, many, trials):
    folder, want = many
    got = {(r.k, c): r[f"clusters_{c}"] for r in figures.tomato_heatmap(spark, folder).collect() for c in (5, 10)}
    assert got == pytest.approx(want)
    trials(failed=True)
    with pytest.raises(RuntimeError, match="1 trials failed.*over 480 s"):
        figures.tomato_heatmap(spark, "")  # a null before
    trials(failed=False)
    assert sorted(map(tuple, figures.tomato_heatmap(spark, "").collect())) == [(5, 0.4, None), (10, None, 0.3)]
