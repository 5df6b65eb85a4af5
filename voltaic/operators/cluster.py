"""Embedding, reduction and clustering of windows, scores, and a resumable grid of trials.

The default embedder and forecaster are deterministic stand-ins for pretrained models, which can't be had here: their interface is the same, their
numbers aren't. A trial holds its points in one task, as any clusterer of this kind does; trials run side by side.
"""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def statistical_embedding(channel: np.ndarray, patches: int = 8) -> np.ndarray:
    """Of each row, one window of a channel: patch means of its z-scores, then its mean and deviation."""
    mean, std = channel.mean(axis=1, keepdims=True), channel.std(axis=1, keepdims=True)
    z = (channel - mean) / np.where(std > 0, std, 1)
    return np.concatenate([p.mean(axis=1, keepdims=True) for p in np.array_split(z, patches, axis=1)] + [mean, std], axis=1)


def embed(windows: DataFrame, keys: Sequence[str], channels: Sequence[str], embedder: Callable[[np.ndarray], np.ndarray] = statistical_embedding) -> DataFrame:
    """``embedding``: the vectors of all channels of each window, one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, sizes = pd.Series([None] * len(b), index=b.index, dtype=object), b[channels[0]].map(len)
            for n, part in b.groupby(sizes, sort=False):
                made = [embedder(np.array(part[c].tolist(), float).reshape(len(part), n)) for c in channels]
                out[part.index] = list(np.concatenate(made, axis=1).astype(np.float32))
            yield b[list(keys)].assign(embedding=out)

    kinds = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys)
    return windows.select(*keys, *channels).mapInPandas(run, f"{kinds}, embedding array<float>")


def pca_components(df: DataFrame, array: str = "embedding", share: float = 0.9) -> int:
    """The least number of principal components (no scaling) that explain a share of the variance."""
    rows = df.select(array_to_vector(F.col(array).cast("array<double>")).alias("v"))
    width = len(rows.first().v)
    explained = PCA(k=width, inputCol="v", outputCol="o").fit(rows).explainedVariance.toArray()
    return int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)


def pca(df: DataFrame, k: int, array: str = "embedding", out: str = "reduced") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(array).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_o").fit(rows).transform(rows).withColumn(out, vector_to_array("_o")).drop("_v", "_o")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


#: Points whose nearest others one task finds.
SLICE_ROWS = 2_048


def shared_knn(spark: SparkSession, points: Broadcast, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``knn`` of points that all tasks have, a slice of them in each."""
    n = len(points.value)
    k = min(k, n - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in b["first"].tolist():
                at, dist = knn(points.value, k, first, first + SLICE_ROWS)
                yield pd.DataFrame({"first": [first], "at": [at.tobytes()], "dist": [dist.tobytes()]})

    slices = -(-n // SLICE_ROWS)
    todo = spark.range(0, n, SLICE_ROWS, slices).withColumnRenamed("id", "first")
    found = sorted(todo.mapInPandas(run, "first long, at binary, dist binary").collect(), key=lambda r: r["first"])
    return tuple(np.concatenate([np.frombuffer(r[c], kind).reshape(-1, k) for r in found]) for c, kind in (("at", np.int64), ("dist", np.float64)))


#: Points of a tile of distances, each way: what a task holds of them at once doesn't grow with the number of points.
TILE_ROWS, TILE_COLUMNS = 512, 4_096
#: Pairs whose differences are held at once.
PAIRS = 1 << 16


def paired_distances(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of places, by differences, so that copies are at exactly zero."""
    out = np.empty(len(a))
    for i in range(0, len(a), PAIRS):
        out[i : i + PAIRS] = np.sqrt(((points[a[i : i + PAIRS]] - points[b[i : i + PAIRS]]) ** 2).sum(axis=1))
    return out


def knn(points: np.ndarray, k: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest others of each point (of those from ``first`` to ``last``), ties by place. Products over tiles say which pairs may be
    among them, their differences which are."""
    n = len(points)
    last = n if last is None else min(last, n)
    points = np.ascontiguousarray(points, float)
    places, dists = np.zeros((last - first, k), np.int64), np.full((last - first, k), np.inf)
    if not k:
        return places, dists
    x = points - points.mean(axis=0)  # products lose less near zero
    squares = (x**2).sum(axis=1)
    other = np.concatenate([-2 * x, squares[:, None]], axis=1)  # times (x, 1): the squared distance less one's own square
    own = np.concatenate([x, np.ones((n, 1))], axis=1)
    slack = 1e-12 * (x.shape[1] + 8) * (squares + squares.max())  # far beyond what rounding can do
    wide = max(TILE_COLUMNS, 2 * (k + 1))
    for i in range(first, last, TILE_ROWS):
        rows = np.arange(i, min(i + TILE_ROWS, last))
        limit = np.full(len(rows), np.inf)
        held_row, held, held_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, n, wide):
            near = own[rows] @ other[j : j + wide].T
            itself = (rows >= j) & (rows < j + near.shape[1])
            near[itself.nonzero()[0], rows[itself] - j] = np.inf
            if not j and near.shape[1] > k:
                limit = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack[rows]
            r, c = np.divmod(np.flatnonzero(~(near > limit[:, None])), near.shape[1])  # what isn't a number stays, as farthest
            keep = rows[r] != c + j
            r, c = r[keep], c[keep] + j
            if not len(r):
                continue
            d = paired_distances(points, rows[r], c)
            held_row, held, held_d = np.concatenate([held_row, r]), np.concatenate([held, c]), np.concatenate([held_d, np.where(np.isnan(d), np.inf, d)])
            order = np.lexsort((held, held_d, held_row))
            held_row, held, held_d = held_row[order], held[order], held_d[order]
            rank = np.arange(len(held)) - np.searchsorted(held_row, held_row)
            held_row, held, held_d, rank = held_row[rank < k], held[rank < k], held_d[rank < k], rank[rank < k]
            full = rank == k - 1
            limit[held_row[full]] = held_d[full] ** 2 - squares[rows[held_row[full]]] + 2 * slack[rows[held_row[full]]]
        places[rows[held_row] - first, rank] = held
        dists[rows[held_row] - first, rank] = held_d
    return places, dists


def tomato(points: np.ndarray, k: int, clusters: int, near: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels of a mode-seeking clustering on the nearest-neighbour graph (``near``: of as many others at least, if known), merged by persistence to ``clusters``; and the
    persistences."""
    k = min(k, len(points) - 1)
    at, dist = (a[:, :k] for a in near or knn(points, k))
    density = 1 / (np.sqrt((dist**2).mean(axis=1)) + 1e-12)
    order = np.argsort(-density, kind="stable")

    def merge(limit: float) -> tuple[np.ndarray, list[float]]:
        root, seen, lost = np.arange(len(points)), np.zeros(len(points), bool), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in order.tolist():
            seen[i] = True
            near = sorted({find(j) for j in at[i].tolist() if seen[j]}, key=lambda r: -density[r])
            if not near:
                continue
            root[i] = near[0]
            for r in near[1:]:
                if density[r] - density[i] < limit:
                    lost.append(density[r] - density[i])
                    root[find(r)] = find(i)
        return np.array([find(i) for i in range(len(points))]), lost

    apart, lost = merge(np.inf)
    peaks = np.sort(np.array(lost))[::-1]
    kept = clusters - len(np.unique(apart))  # parts of the graph that aren't connected stay apart anyway
    limit = peaks[min(kept, len(peaks)) - 1] if kept > 0 and len(peaks) else np.inf
    labels, _ = merge(limit)
    return np.unique(labels, return_inverse=True)[1], peaks


def spanning_tree(points: np.ndarray, least: int, core: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """The edges of the mutual-reachability spanning tree (distance and both ends), shortest first. ``core``: distances of the ``least``-nearest others, if known."""
    n = len(points)
    if n < 2:
        return []
    points = np.ascontiguousarray(points, float)
    if core is None:
        core = knn(points, min(least, n - 1))[1][:, -1]
    x = points - points.mean(axis=0)
    squares = (x**2).sum(axis=1)
    slack = 1e-12 * (x.shape[1] + 8) * (squares + squares.max())
    best, link = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.zeros(n)  # infinite inside of the tree
    edges, cur = [], 0
    # Only points that a shorter edge may still reach are compared: none is shorter than the core distance of its end.
    some, part, own, closed = np.arange(n), x, squares + slack, 0
    for _ in range(n - 1):  # Prim
        left[cur] = np.inf
        now = best[some]
        maybe = np.flatnonzero((own + squares[cur] - 2 * (part @ x[cur]) < now**2) & (now > core[cur]))
        at = some[maybe]
        at = at[left[at] == 0]
        d = np.maximum(paired_distances(points, at, np.full(len(at), cur)), np.maximum(core[at], core[cur]))
        better = d < best[at]
        at, d = at[better], d[better]
        best[at], link[at] = d, cur
        closed += 1 + int((d <= core[at]).sum())
        if closed * 8 > len(some):
            some = some[(left[some] == 0) & (best[some] > core[some])]
            part, own, closed = x[some], (squares + slack)[some], 0
        cur = int((best + left).argmin())
        edges.append((float(best[cur]), int(link[cur]), cur))
    return sorted(edges)


def relative_validity(edges: list[tuple[float, int, int]], labels: np.ndarray) -> float | None:
    """A density-based validity (-1 to 1) from the spanning tree: each cluster's longest inner edge against the shortest one that leaves it for another
    cluster, weighted by size; noise counts in the whole. None without two clusters."""
    names = np.unique(labels[labels != -1])
    if len(names) < 2:
        return None
    inner, outer = dict.fromkeys(names.tolist(), 0.0), dict.fromkeys(names.tolist(), np.inf)
    longest = max((d for d, *_ in edges), default=0.0)
    for d, a, b in edges:
        x, y = int(labels[a]), int(labels[b])
        if x == y and x != -1:
            inner[x] = max(inner[x], d)
        elif x != y and x != -1 and y != -1:
            outer[x], outer[y] = min(outer[x], d), min(outer[y], d)
    total = 0.0
    for c in names.tolist():
        apart = outer[c] if np.isfinite(outer[c]) else longest
        total += int((labels == c).sum()) * (apart - inner[c]) / max(apart, inner[c], 1e-300)
    return total / len(labels)


def hdbscan(points: np.ndarray, least: int, edges: list[tuple[float, int, int]] | None = None) -> np.ndarray:
    """Density clusters by excess of mass over the mutual-reachability spanning tree (``edges``, if known); -1 is noise."""
    n = len(points)
    if n < 2:
        return np.full(n, -1)
    edges = spanning_tree(points, least) if edges is None else edges
    parent, tree, size = list(range(2 * n - 1)), {}, [1] * n + [0] * (n - 1)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (d, a, b) in enumerate(edges):
        a, b = find(a), find(b)
        node = n + i
        parent[a] = parent[b] = node
        tree[node], size[node] = (a, b, d), size[a] + size[b]

    def leaves(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += tree[y][:2]
        return out

    # Condensed tree, from the root down: birth, mass and children of each cluster.
    clusters, todo = [{"node": 2 * n - 2, "birth": 0.0, "up": -1}], [(2 * n - 2, 0)]
    mass, kids = [0.0], [[]]
    while todo:
        x, c = todo.pop()
        if x < n:
            continue
        a, b, d = tree[x]
        lam = 1 / d if d > 0 else 1e12
        big = [y for y in (a, b) if size[y] >= least]
        if len(big) == 2:
            mass[c] += size[x] * (lam - clusters[c]["birth"])
            for y in big:
                clusters.append({"node": y, "birth": lam, "up": c})
                mass.append(0.0)
                kids.append([])
                kids[c].append(len(clusters) - 1)
                todo.append((y, len(clusters) - 1))
        else:
            for y in (a, b):
                if y in big:
                    todo.append((y, c))
                else:
                    mass[c] += size[y] * (lam - clusters[c]["birth"])
    chosen = [False] * len(clusters)
    for c in range(len(clusters) - 1, 0, -1):
        below = sum(mass[x] for x in kids[c])
        if not kids[c] or mass[c] >= below:
            chosen[c] = True
        else:
            mass[c] = below
    labels, label = np.full(n, -1), 0
    for c in range(1, len(clusters)):
        up = clusters[c]["up"]
        while up > 0 and not chosen[up]:
            up = clusters[up]["up"]
        if chosen[c] and up <= 0:
            labels[leaves(clusters[c]["node"])] = label
            label += 1
    return labels


def layout_curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """``a``, ``b`` for which 1 / (1 + a x^2b) is nearest to 1 up to ``min_dist`` and an exponential beyond, by damped least squares."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    target = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    curve = lambda v: 1 / (1 + np.exp(v[0]) * x ** (2 * np.exp(v[1])))
    v, damping = np.zeros(2), 1e-2
    error = ((curve(v) - target) ** 2).sum()
    for _ in range(500):
        f = curve(v)
        power = np.exp(v[0]) * x ** (2 * np.exp(v[1]))
        slope = np.stack([-(f**2) * power, -(f**2) * power * 2 * np.exp(v[1]) * np.log(x)], axis=1)
        square = slope.T @ slope
        new = v - np.linalg.solve(square + damping * np.diag(np.diag(square) + 1e-12), slope.T @ (f - target))
        got = ((curve(new) - target) ** 2).sum()
        if got < error:
            done = error - got < 1e-12
            v, error, damping = new, got, damping / 3
            if done:
                break
        else:
            damping *= 4
    return float(np.exp(v[0])), float(np.exp(v[1]))


def fuzzy_graph(points: np.ndarray, neighbours: int, near: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ends and weights of the edges of the fuzzy neighbour graph: weights decay beyond the nearest neighbour so that they sum to log2 of the number of
    neighbours, and an edge is there if either end has it."""
    n = len(points)
    k = min(neighbours, n - 1)
    at, dist = (a[:, :k] for a in near or knn(points, k))
    nearest = np.where(dist > 0, dist, np.inf).min(axis=1, keepdims=True)
    beyond = np.maximum(dist - np.where(np.isfinite(nearest), nearest, 0), 0)
    low, high, target = np.zeros((n, 1)), np.full((n, 1), np.inf), np.log2(max(k, 2))
    width = np.ones((n, 1))
    for _ in range(64):
        over = np.exp(-beyond / width).sum(axis=1, keepdims=True) > target
        low, high = np.where(over, low, width), np.where(over, width, high)
        width = np.where(np.isfinite(high), (low + high) / 2, width * 2)
        width = np.minimum(width, 1e12)
    width = np.maximum(width, 1e-3 * np.maximum(dist.mean(axis=1, keepdims=True), 1e-12))
    w = np.exp(-beyond / width)
    head, tail, weight = np.repeat(np.arange(n), k), at.ravel(), w.ravel()
    key = np.concatenate([head * n + tail, tail * n + head])
    order = np.argsort(key, kind="stable")
    key, both = key[order], np.concatenate([weight, weight])[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    union = 1 - np.multiply.reduceat(1 - both, first)  # a + b - ab
    return key[first] // n, key[first] % n, union


def umap(points: np.ndarray, neighbours: int, min_dist: float, dims: int = 2, epochs: int = 200, seed: int = 42, negatives: int = 5, near: tuple | None = None) -> np.ndarray:
    """A layout of the fuzzy neighbour graph: edges attract as often as their weight says, and each time push ``negatives`` random points away. It begins with the
    principal components; the moves of an epoch are made together. ``near``: the nearest others, if known."""
    n = len(points)
    if n < 3:
        return np.zeros((n, dims))
    head, tail, weight = fuzzy_graph(points, neighbours, near)
    a, b = layout_curve(min_dist)
    rng = np.random.default_rng(seed)
    centred = points - points.mean(axis=0)
    y = np.zeros((n, dims))
    first = centred @ np.linalg.svd(centred, full_matrices=False)[2][:dims].T
    y[:, : first.shape[1]] = first / (np.abs(first).max() or 1.0) * 10
    y += rng.normal(0, 1e-4, y.shape)
    y = np.ascontiguousarray(y.T)  # a row for each dimension
    del centred, first
    rate = weight / weight.max()
    taken = np.zeros(len(weight))
    held = max(1, MOVES // (dims * max(negatives, 1)))
    for e in range(epochs):
        step = 1.0 - e / epochs
        upto = np.floor(rate * (e + 1))
        now = np.flatnonzero(upto > taken)
        taken = upto
        move = np.zeros_like(y)
        for s in range(0, len(now), held):
            i, j = head[now[s : s + held]], tail[now[s : s + held]]
            apart = y[:, i] - y[:, j]
            d2 = np.maximum((apart**2).sum(axis=0), 1e-12)
            pull = np.clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) * apart, -4, 4)
            _add(move, i, pull)
            _add(move, j, -pull)
            i = np.repeat(i, negatives)
            other = rng.integers(0, n, len(i))
            apart = y[:, i] - y[:, other]
            d2 = (apart**2).sum(axis=0)
            _add(move, i, np.where(i != other, np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * apart, -4, 4), 0))
        times = np.bincount(head[now], minlength=n) + np.bincount(tail[now], minlength=n)
        y += step * move / np.maximum(times, 1) ** 0.5
    return np.ascontiguousarray(y.T)


#: Numbers of a part of the moves that is held at once.
MOVES = 1 << 20


def _add(move: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
    """Add to places of each row, one after another where they repeat."""
    for row, x in zip(move, by, strict=True):
        np.add.at(row, at, x)


def tsne(points: np.ndarray, perplexity: float = 30.0, iterations: int = 500, seed: int = 42) -> np.ndarray:
    """A layout in two dimensions whose Student t similarities are near to Gaussian ones of standardised points; for a display of a bounded sample."""
    n = len(points)
    if n < 3:
        return np.zeros((n, 2))
    std = points.std(axis=0)
    x = (points - points.mean(axis=0)) / np.where(std > 0, std, 1)
    squares = (x**2).sum(axis=1)
    d = np.maximum(squares[:, None] + squares - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    low, high, beta = np.zeros((n, 1)), np.full((n, 1), np.inf), np.ones((n, 1)) / np.median(d[np.isfinite(d)])
    least = d.min(axis=1, keepdims=True)
    for _ in range(60):
        p = np.exp(-(d - least) * beta)
        p /= p.sum(axis=1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1, keepdims=True)
        wide = entropy > np.log(min(perplexity, (n - 1) / 3))
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isfinite(high), (low + high) / 2, beta * 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rng = np.random.default_rng(seed)
    first = x @ np.linalg.svd(x, full_matrices=False)[2][:2].T
    y = np.pad(first, ((0, 0), (0, 2 - first.shape[1]))) / (first[:, 0].std() or 1) * 1e-4 + rng.normal(0, 1e-6, (n, 2))
    speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50)
    for k in range(iterations):
        near = 1 / (1 + np.maximum((y**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * y @ y.T, 0))
        np.fill_diagonal(near, 0)
        q = np.maximum(near / near.sum(), 1e-12)
        force = ((12 if k < 100 else 1) * p - q) * near
        slope = 4 * (force.sum(axis=1)[:, None] * y - force @ y)
        gain = np.maximum(np.where((slope > 0) != (speed > 0), gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if k < 100 else 0.8) * speed - rate * gain * slope
        y = y + speed
    return y - y.mean(axis=0)


def silhouette(points: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean Euclidean silhouette over points that aren't noise; None with fewer than two clusters or too few points."""
    keep = labels != -1
    x, y = points[keep], labels[keep]
    names, code, counts = np.unique(y, return_inverse=True, return_counts=True)
    if len(names) < 2 or len(x) <= len(names):
        return None
    order = np.argsort(code, kind="stable")  # the points of a cluster side by side
    x, code = x[order], code[order]
    squares = (x**2).sum(axis=1)
    total = 0.0
    high = max(1, min(TILE_ROWS, TILE_ROWS * TILE_COLUMNS // len(names)))
    for i in range(0, len(x), high):
        own = code[i : i + high]
        rows = np.arange(len(own))
        sums = np.zeros((len(own), len(names)))
        for j in range(0, len(x), TILE_COLUMNS):
            other = code[j : j + TILE_COLUMNS]
            d = np.sqrt(np.maximum(squares[i : i + high, None] + squares[j : j + TILE_COLUMNS] - 2 * x[i : i + high] @ x[j : j + TILE_COLUMNS].T, 0))
            itself = (i + rows >= j) & (i + rows < j + len(other))
            d[rows[itself], i + rows[itself] - j] = 0
            sums[:, other[0] : other[-1] + 1] += np.add.reduceat(d, np.flatnonzero(np.append(True, other[1:] != other[:-1])), axis=1)
        a = sums[rows, own] / np.maximum(counts[own] - 1, 1)
        sums /= counts
        sums[rows, own] = np.inf
        b = sums.min(axis=1)
        s = (b - a) / np.maximum(np.maximum(b, a), 1e-300)
        total += float(np.where(counts[own] > 1, s, 0).sum())
    return total / len(x)


def _has_silhouette(labels: np.ndarray) -> bool:
    return 2 <= len(np.unique(labels)) < len(labels)


def silhouette_sums(points: np.ndarray, labels: np.ndarray, first: int = 0, last: int | None = None) -> list[float]:
    """Of each labelling without noise (a row of ``labels``), the sum of the Euclidean silhouettes of all points (of those from ``first`` to ``last`` in the order of the
    labels). All labellings share the distances of a tile, and their sums over the points that no labelling parts."""
    n = len(points)
    last = n if last is None else min(last, n)
    codes, counts = zip(*(np.unique(row, return_inverse=True, return_counts=True)[1:] for row in labels), strict=True)
    order = np.lexsort(codes)
    codes = [c[order] for c in codes]
    part = np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0))  # where a labelling goes on to another cluster
    x = (points - points.mean(axis=0))[order]  # products lose less near zero
    squares, ones = (x**2).sum(axis=1)[:, None], np.ones((n, 1))
    one, other = np.concatenate([x, ones, squares], axis=1), np.concatenate([-2 * x, squares, ones], axis=1)  # whose product is the squared distance
    totals = [0.0] * len(codes)
    high = max(1, min(TILE_ROWS, TILE_ROWS * TILE_COLUMNS // sum(map(len, counts))))
    tile = np.empty((high, TILE_COLUMNS))
    for i in range(first, last, high):
        rows = np.arange(i, min(i + high, last))
        sums = [np.zeros((len(rows), len(c))) for c in counts]
        for j in range(0, n, TILE_COLUMNS):
            d = tile[: len(rows), : min(TILE_COLUMNS, n - j)]
            np.matmul(one[rows[0] : rows[-1] + 1], other[j : j + TILE_COLUMNS].T, out=d)
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            itself = (rows >= j) & (rows < j + d.shape[1])
            d[itself.nonzero()[0], rows[itself] - j] = 0
            starts = np.flatnonzero(np.append(True, part[j + 1 : j + d.shape[1]]))
            d = np.add.reduceat(d, starts, axis=1)
            for total, code in zip(sums, codes, strict=True):
                by = np.argsort(code[j + starts], kind="stable")
                names, at = np.unique(code[j + starts][by], return_index=True)
                total[:, names] += np.add.reduceat(d[:, by], at, axis=1)
        for t, (total, code, count) in enumerate(zip(sums, codes, counts, strict=True)):
            own = code[rows]
            a = total[rows - i, own] / np.maximum(count[own] - 1, 1)
            total /= count
            total[rows - i, own] = np.inf
            b = total.min(axis=1)
            totals[t] += float(np.where(count[own] > 1, (b - a) / np.maximum(np.maximum(b, a), 1e-300), 0).sum())
    return totals


def shared_silhouettes(spark: SparkSession, points: Broadcast, labels: np.ndarray) -> list[float | None]:
    """The mean silhouette of each labelling without noise (a row of ``labels``) over all of the points that all tasks have, a slice of them in each; None with fewer
    than two clusters or too few points."""
    n, good = len(points.value), [i for i, row in enumerate(labels) if _has_silhouette(row)]
    means: list[float | None] = [None] * len(labels)
    if not good:
        return means
    given = spark.sparkContext.broadcast(labels[good])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in b["first"].tolist():
                yield pd.DataFrame({"first": [first], "sums": [silhouette_sums(points.value, given.value, first, first + SLICE_ROWS)]})

    todo = spark.range(0, n, SLICE_ROWS, -(-n // SLICE_ROWS)).withColumnRenamed("id", "first")
    found = sorted(todo.mapInPandas(run, "first long, sums array<double>").collect(), key=lambda r: r["first"])
    for i, total in zip(good, np.sum([r["sums"] for r in found], axis=0).tolist(), strict=True):
        means[i] = total / n
    return means


#: Points of a block that goes to all tasks.
BLOCK_ROWS = 20_000


def _against_blocks(points: DataFrame, columns: Sequence[str], f: Callable, schema: str, array: str = "embedding") -> DataFrame:
    """``f(rows, block)`` of each batch of a table against every block of it: blocks of about ``BLOCK_ROWS`` points, one after another sent to all tasks, so that neither
    the driver nor a task holds more than one."""
    spark, count = points.sparkSession, points.count()
    blocks = max(1, -(-count // BLOCK_ROWS))
    dealt = points.withColumn("_block", F.pmod(F.xxhash64(*columns), F.lit(blocks)))
    out = None
    for b in range(blocks):
        shared = spark.sparkContext.broadcast(dealt.where(F.col("_block") == b).select(*columns, array).toPandas())

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            block = shared.value
            y = np.array(block[array].tolist(), float).reshape(len(block), -1)
            for rows in batches:
                for i in range(0, len(rows), 512):
                    part = rows.iloc[i : i + 512]
                    x = np.array(part[array].tolist(), float)
                    if not len(y):
                        continue
                    d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0))
                    yield f(part, block, d)

        found = points.select(*columns, array).mapInPandas(run, schema)
        out = found if out is None else out.union(found)
    return out


def neighbours(points: DataFrame, k: int, key: str = "vec_id", array: str = "embedding") -> DataFrame:
    """``other``, ``rank``, ``distance`` of the k nearest others of each point, ties by key."""

    def nearest(rows: pd.DataFrame, block: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        ids, others = rows[key].to_numpy(), block[key].to_numpy()
        d = np.where(ids[:, None] == others, np.inf, np.round(d, 9))
        order = np.lexsort((np.broadcast_to(others, d.shape), d), axis=1)[:, :k]
        got = pd.DataFrame({key: np.repeat(ids, order.shape[1]), "other": others[order].ravel(), "distance": np.take_along_axis(d, order, axis=1).ravel()})
        return got[np.isfinite(got["distance"])]

    kind = points.schema[key].dataType.simpleString()
    found = _against_blocks(points, [key], nearest, f"`{key}` {kind}, other {kind}, distance double", array)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", "other")))
    return ranked.where(F.col("rank") <= k)


def mean_silhouette(points: DataFrame, key: str = "vec_id", label: str = "label", array: str = "embedding", noise: int = -1) -> DataFrame:
    """``silhouette``: the mean Euclidean one over points that aren't noise; null with fewer than two clusters or too few points."""
    own = points.where(F.col(label) != noise)

    def sums(rows: pd.DataFrame, block: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        d = np.where(rows[key].to_numpy()[:, None] == block[key].to_numpy(), 0, d)
        names, code = np.unique(block[label].to_numpy(), return_inverse=True)
        total = d @ np.eye(len(names))[code]
        n = len(names)
        return pd.DataFrame({key: np.repeat(rows[key].to_numpy(), n), label: np.repeat(rows[label].to_numpy(), n), "other": np.tile(names, len(rows)), "total": total.ravel()})

    kinds = [points.schema[c].dataType.simpleString() for c in (key, label)]
    part = _against_blocks(own, [key, label], sums, f"`{key}` {kinds[0]}, `{label}` {kinds[1]}, other {kinds[1]}, total double", array)
    size = own.groupBy(F.col(label).alias("other")).agg(F.count("*").alias("n"))
    mean = part.groupBy(key, label, "other").agg(F.sum("total").alias("total")).join(F.broadcast(size), "other")
    mine = F.col("other") == F.col(label)
    by = mean.groupBy(key, label).agg(
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"), F.max(F.when(mine, F.col("n"))).alias("own")
    )
    one = F.when(F.col("own") > 1, F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).otherwise(0.0)
    found = by.agg(F.avg(F.coalesce(one, F.lit(0.0))).alias("s"), F.countDistinct(label).alias("k"), F.count("*").alias("n"))
    return found.select(F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), F.col("s")).alias("silhouette"))


def ranked(results: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """Results with their ``rank``: best score first, missing ones last, ties by parameters. A row for each trial reaches the window."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc_nulls_last(score), *keys)))


def finished(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The results of all trials; raises RuntimeError if one failed, as what is left of them isn't the whole."""
    failed = results.where("not status <=> 'ok'").select(*keys, "status").orderBy(*keys).collect()  # a row for each trial at most
    if failed:
        raise RuntimeError(f"{len(failed)} trials failed: {', '.join(str(r.asDict()) for r in failed)}")
    return results


def best(results: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """The best trial; raises RuntimeError if none has a score."""
    row = results.where(F.col(score).isNotNull()).orderBy(F.desc(score), *keys).limit(1)
    if row.isEmpty():
        raise RuntimeError("no trial has a score")
    return row


def heat_map(results: DataFrame, row: str, column: str, score: str, columns: Sequence) -> DataFrame:
    """The best score of each pair of parameters, a column for each value of one of them, whether it was tried or not."""
    wide = results.groupBy(row).pivot(column, list(columns)).agg(F.max(score))
    return wide.select(row, *[F.col(f"`{c}`").alias(f"{column}_{c}") for c in columns])


def gated(score: Column, noise: Column, most: float = 0.05) -> Column:
    """A score counts only if at most this share is noise."""
    return F.when(noise <= most, score)


def grid(spark, **values: Sequence) -> DataFrame:
    """All combinations of parameters, a row each."""
    from itertools import product

    return spark.createDataFrame([tuple(x) for x in product(*values.values())], list(values))


def trial_layout(points: np.ndarray, neighbours: int, min_dist: float, most: int, dims: int = 20, near: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The layout that trials share, and the distances of its ``most``-nearest others."""
    y = umap(points, neighbours, min_dist, min(dims, points.shape[1]), epochs=100, near=near)
    return y, knn(y, max(min(most, len(y) - 1), 0))[1]


def layout_score(y: np.ndarray, dist: np.ndarray, least: int) -> dict:
    """Clusters, share of noise, silhouette and density-based validity of the density clusters of a layout."""
    edges = spanning_tree(y, least, dist[:, min(least, len(y) - 1) - 1] if len(y) > 1 else None)
    labels = hdbscan(y, least, edges)
    return {"n_clusters": len(set(labels.tolist()) - {-1}), "noise": float((labels == -1).mean()), "silhouette": silhouette(y, labels), "validity": relative_validity(edges, labels)}


def layout_trial(points: np.ndarray, neighbours: int, min_dist: float, least: int, dims: int = 20) -> dict:
    return layout_score(*trial_layout(points, neighbours, min_dist, least, dims), least)


def mode_labels(points: np.ndarray, k: int, clusters: int, near: tuple | None = None) -> dict:
    """Labels (as bytes), clusters and the last kept persistence of a mode-seeking clustering; raises ValueError if a coordinate isn't a number."""
    if not np.isfinite(points).all():
        raise ValueError(f"{int((~np.isfinite(points)).any(axis=1).sum())} points have a coordinate that isn't a finite number")
    labels, lost = tomato(points, k, clusters, near)
    finite = lost[np.isfinite(lost)]
    return {"n_found": len(np.unique(labels)), "noise": 0.0, "persistence": float(finite[-1]) if len(finite) else None, "labels": labels.astype(np.int32).tobytes()}


def mode_trial(points: np.ndarray, k: int, clusters: int, near: tuple | None = None) -> dict:
    """Clusters, silhouette (of all points) and the last kept persistence of a mode-seeking clustering."""
    found = mode_labels(points, k, clusters, near)
    labels = np.frombuffer(found.pop("labels"), np.int32)[None]
    return found | {"silhouette": silhouette_sums(points, labels)[0] / len(points) if _has_silhouette(labels[0]) else None}


def scored_modes(results: DataFrame, points: Broadcast, keys: Sequence[str]) -> DataFrame:
    """Results of ``mode_labels`` with the ``silhouette`` of all points in place of the labels; null where a trial failed."""
    spark = results.sparkSession
    done = results.where("status = 'ok'").select(*keys, "labels").orderBy(*keys).collect()  # a row for each trial
    scores = shared_silhouettes(spark, points, np.array([np.frombuffer(r["labels"], np.int32) for r in done]).reshape(len(done), len(points.value)))
    kinds = ", ".join(f"`{k}` {results.schema[k].dataType.simpleString()}" for k in keys)
    scored = spark.createDataFrame([(*r[: len(keys)], s) for r, s in zip(done, scores, strict=True)], f"{kinds}, silhouette double")
    return results.drop("labels").join(F.broadcast(scored), list(keys), "left")


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Raise TimeoutError in the task's main thread after so long."""

    def late(*_) -> None:
        raise TimeoutError(f"over {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def resumed_grid(todo: DataFrame, path: str, keys: Sequence[str], trial: Callable[..., dict], result: str, batch: int = 16, **limits: float) -> DataFrame:
    """The results of all trials, kept under a path in batches: after a stop, only what isn't there is run. Trials that failed are run again."""
    spark = todo.sparkSession
    names = [c.split()[0] for c in result.split(", ")]
    empty = spark.createDataFrame([], result)

    def kept() -> DataFrame:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return spark.read.schema(empty.schema).parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else empty

    open_ = [tuple(r) for r in todo.select(*keys).join(kept().where("status = 'ok'"), list(keys), "left_anti").orderBy(*keys).collect()]  # a row for each trial
    for i in range(0, len(open_), batch):
        part = spark.createDataFrame(open_[i : i + batch], todo.select(*keys).schema)
        run_grid(part.repartition(len(open_[i : i + batch]), *keys), None, keys, trial, result, **limits).write.mode("append").parquet(path)
    latest = kept().withColumn("_ok", F.col("status") == "ok")
    return latest.groupBy(*keys).agg(F.max_by(F.struct(*names), "_ok").alias("r")).select("r.*")


def run_grid(
    todo: DataFrame, done: DataFrame | None, keys: Sequence[str], trial: Callable[..., dict], result: str, timeout: float = 480, tries: int = 10, wait: float = 30, shared: Sequence[str] = (), begin: Callable | None = None
) -> DataFrame:
    """Run the trials that aren't done yet, each in a task of its own; an error, or more than ``timeout`` seconds, becomes a row with its message in ``status``.
    A lost connection is tried again, after ``wait`` seconds more each time; resuming runs again what isn't in ``done``. Trials that are equal in the keys ``shared`` run
    in one task, and get as ``begun`` what ``begin`` made of these, within the same limits; its error is that of each."""
    left = todo.join(done, list(keys), "left_anti") if done is not None else todo

    def tried(f: Callable, args: dict) -> tuple[object, str]:
        for attempt in range(1, tries + 1):
            try:
                with time_limit(timeout):
                    return f(**args), "ok"
            except Exception as error:  # noqa: BLE001  a failed trial is a result
                status = f"error: {error}"[:80]
                if not isinstance(error, ConnectionError) or attempt == tries:
                    return None, status
            time.sleep(wait * attempt)

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, begun, status = [], None, "ok"
        if begin:
            begun, status = tried(begin, {k: pdf[k].iloc[0] for k in shared})
        for i in range(len(pdf) if begin else 1):
            args = {k: pdf[k].iloc[i] for k in keys}
            out, end = tried(trial, args | ({"begun": begun} if begin else {})) if status == "ok" else (None, status)
            rows.append(args | (out or {}) | {"status": end})
        return pd.DataFrame(rows).reindex(columns=[c.split()[0] for c in result.split(", ")])

    return left.groupBy(*(shared if begin else keys)).applyInPandas(some, result)
