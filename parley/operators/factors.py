"""Least squares over any number of rows by triangular factors.

A task reduces its rows of (1, x, y) to the triangular factor of their QR decomposition; factors merge by decomposing two
of them stacked, first within groups of tasks, then over the groups. No products are summed, so nothing is squared: a
condition of c costs log10(c) digits. Each factor keeps the row it is measured from, and merging moves a factor to
another's by their difference; so a common offset of any size, such as a date in seconds, costs no digits at all. As
the ones come first, what stands below the first row of a factor is the factor of the centred columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows decomposed at once, and groups of tasks whose factors merge before all do.
BLOCK_ROWS = 4096
GROUPS = 32


@dataclass
class Factor:
    """``r``: the triangular factor of n rows (1, x - origin, y - origin)."""

    n: int
    origin: np.ndarray
    r: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Factor:
        """Of rows (x, y); at least one."""
        origin = rows[0].copy()
        out = None
        for at in range(0, len(rows), BLOCK_ROWS):
            part = rows[at : at + BLOCK_ROWS] - origin
            one = np.column_stack([np.ones(len(part)), part])
            out = np.linalg.qr(one if out is None else np.vstack([out, one]), mode="r")
        return Factor(len(rows), origin, _square(out))

    def merge(self, other: Factor) -> Factor:
        r = other.r.copy()
        r[0, 1:] += r[0, 0] * (other.origin - self.origin)
        return Factor(self.n + other.n, self.origin, _square(np.linalg.qr(np.vstack([self.r, r]), mode="r")))

    @staticmethod
    def all(parts: Iterable[Factor]) -> Factor:
        """Merged pairwise, so that rounding grows with the logarithm of their number."""
        level = list(parts)
        while len(level) > 1:
            level = [level[i].merge(level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def solve(self, penalty: float = 0.0) -> Solution:
        """The line of y (the last column) on x; ``penalty`` times the squared coefficients is added to the squares."""
        k = len(self.origin) - 1
        x, c, rest = self.r[1 : k + 1, 1 : k + 1], self.r[1 : k + 1, k + 1], self.r[k + 1, k + 1]
        total = float(c @ c + rest * rest)
        scale = np.sqrt((x * x).sum(axis=0))
        scale[scale == 0] = 1.0
        if penalty:
            u, s, v = np.linalg.svd(np.vstack([x, np.sqrt(penalty) * np.eye(k)]), full_matrices=False)
            beta, rank = v.T @ ((u.T @ np.concatenate([c, np.zeros(k)])) / np.where(s > 0, s, np.inf)), k
            explained = total - float(rest * rest + ((c - x @ beta) ** 2).sum())
        else:
            u, s, v = np.linalg.svd(x / scale)
            rank = int((s > s[0] * max(self.n, k) * np.finfo(float).eps).sum()) if k and s[0] > 0 else 0
            on = u[:, :rank].T @ c
            beta, explained = (v[:rank].T @ (on / s[:rank])) / scale, float(on @ on)
        means = self.origin + self.r[0, 1:] / self.r[0, 0]
        intercept = float(self.origin[k] + (self.r[0, k + 1] / self.r[0, 0] - means[:k] @ beta))
        return Solution(self.n, rank, Vectors.dense(beta), intercept, explained / total if total > 0 else 0.0)


@dataclass
class Solution:
    n: int
    rank: int
    coefficients: DenseVector
    intercept: float
    r2: float

    def predict(self, features: Column) -> Column:
        """The fitted value at an array column, in the JVM."""
        weights = F.array(*[F.lit(float(b)) for b in self.coefficients])
        terms = F.zip_with(features.cast("array<double>"), weights, lambda a, b: a * b)
        return F.aggregate(terms, F.lit(self.intercept), lambda s, t: s + t)


def _square(r: np.ndarray) -> np.ndarray:
    """``r`` with rows of zeros where there were fewer rows than columns."""
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))]) if len(r) < r.shape[1] else r


_SHAPE = "k int, part int, n long, origin array<double>, r array<double>"


def _row(k: int, part: int, f: Factor) -> pd.DataFrame:
    return pd.DataFrame({"k": [k], "part": [part], "n": [f.n], "origin": [f.origin], "r": [f.r.ravel()]})


def factors_of(f: pd.DataFrame) -> list[Factor]:
    return [Factor(int(n), np.array(o, float), np.array(r, float).reshape(len(o) + 1, len(o) + 1)) for n, o, r in zip(f["n"], f["origin"], f["r"])]


def triangular_factors(rows: DataFrame) -> DataFrame:
    """One factor a setting (``k, part, n, origin, r``) of rows (k, x of any fixed length a setting, y) in one pass.

    Rows with a missing or non-finite value are left out. A task holds one factor a setting and a block of rows; of its
    factors those of ``GROUPS`` groups of tasks meet, then those of the groups: some (columns + 2)**2 numbers each.
    """

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Factor] = {}
        part = 0
        for f in frames:
            part = int(f["part"].iloc[0]) if len(f) else part
            for k, same in f.groupby("k"):
                z = np.column_stack([np.array(same["x"].tolist(), float).reshape(len(same), -1), same["y"].to_numpy(float)])
                z = z[np.isfinite(z).all(axis=1)]
                if len(z):
                    held[k] = held[k].merge(Factor.of(z)) if k in held else Factor.of(z)
        for k, f in held.items():
            yield _row(k, part, f)

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        return _row(int(f["k"].iloc[0]), int(f["part"].min()), Factor.all(factors_of(f)))

    whole = ~F.exists("x", lambda v: v.isNull())
    known = rows.select(F.col("k").cast("int").alias("k"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")).dropna().filter(whole)
    each = known.withColumn("part", F.spark_partition_id() % GROUPS).mapInPandas(reduce, _SHAPE)
    return each.groupBy("k", "part").applyInPandas(meet, _SHAPE).groupBy("k").applyInPandas(meet, _SHAPE)


def fitted(rows: DataFrame, features: str, target: str, penalty: float = 0.0) -> Solution:
    """The least-squares line of a column on an array column; what reaches the driver is one factor."""
    found = triangular_factors(rows.select(F.lit(0).alias("k"), F.col(features).alias("x"), F.col(target).alias("y"))).toPandas()
    if not len(found):
        raise ValueError("no complete row to fit")
    return factors_of(found)[0].solve(penalty)
