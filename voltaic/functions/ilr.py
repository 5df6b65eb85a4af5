"""Isometric log-ratio coordinates of compositions, as generated column expressions (no Python at run time)."""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts and the sequential binary partition (signs of each part by coordinate), in the order of the parts.
PARTS = ["natural_gas", "nuclear", "hydro", "wind", "solar", "coal", "oil", "other"]
PARTITION = [
    [1, 1, -1, -1, -1, 1, 1, 1],
    [1, -1, 0, 0, 0, 1, 1, -1],
    [1, 0, 0, 0, 0, -1, -1, 0],
    [0, 0, 0, 0, 0, 1, -1, 0],
    [0, 1, 0, 0, 0, 0, 0, -1],
    [0, 0, 1, -1, -1, 0, 0, 0],
    [0, 0, 0, -1, 1, 0, 0, 0],
]
ZERO_REPLACEMENT = 1e-4


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chain_partition(n: int) -> list[list[int]]:
    """The partition that splits off one part after another: the i-th against all later ones."""
    return [[0] * i + [1] + [-1] * (n - i - 1) for i in range(n - 1)]


def total(columns: list) -> Column:
    return reduce(lambda a, b: a + b, map(_c, columns))


def replace_zeros(shares: list, delta: float = ZERO_REPLACEMENT) -> list[Column]:
    """Shares of at most zero become ``delta``, then all are divided by their sum; a null in any makes all null."""
    filled = [F.when(_c(s) <= 0, F.lit(delta)).otherwise(_c(s)) for s in shares]
    return [F.try_divide(s, total(filled)) for s in filled]


def basis(partition: list[list[int]]) -> list[list[float]]:
    """Orthonormal rows, one for each coordinate."""
    rows = []
    for signs in partition:
        r, s = signs.count(1), signs.count(-1)
        rows.append([{1: sqrt(s / (r * (r + s))) if r else 0.0, -1: -sqrt(r / (s * (r + s))) if s else 0.0, 0: 0.0}[x] for x in signs])
    return rows


def forward(shares: list, partition: list[list[int]]) -> list[Column]:
    """Coordinates: sqrt(rs/(r+s)) times the difference of mean logarithms of the two sides."""
    out = []
    for signs in partition:
        sides = [[F.ln(_c(x)) for x, sign in zip(shares, signs, strict=True) if sign == side] for side in (1, -1)]
        r, s = map(len, sides)
        out.append(F.lit(sqrt(r * s / (r + s))) * (total(sides[0]) / F.lit(float(r)) - total(sides[1]) / F.lit(float(s))))
    return out


def inverse(coordinates: list, partition: list[list[int]]) -> list[Column]:
    """Shares from coordinates: a softmax of the basis-weighted sums."""
    rows = basis(partition)
    logs = [total([F.lit(rows[j][i]) * _c(z) for j, z in enumerate(coordinates)]) for i in range(len(partition[0]))]
    powers = [F.exp(x) for x in logs]
    return [p / total(powers) for p in powers]
