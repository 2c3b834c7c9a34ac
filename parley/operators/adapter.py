"""A low-rank adapter on a frozen linear classifier: what fine-tuning by adapters does, at a size that trains here.

Scores of a vector x are (W + A B) x. W stays as it is; A and B, of ``rank`` columns and rows, are learned by gradient steps
on the cross entropy. A step is one job: every task sums up the gradients of its rows, of all folds at once; sums meet in
groups of tasks and then on the driver, which holds the matrices (classes times dimensions), never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.order import held

GROUPS = 16


@dataclass
class Adapter:
    labels: list[str]
    base: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return self.base + self.a @ self.b

    @property
    def share(self) -> float:
        """Trained parameters per frozen one."""
        return (self.a.size + self.b.size) / self.base.size


def prototypes(rows: DataFrame, features: str, label: str, scale: float = 4.0) -> tuple[list[str], np.ndarray]:
    """Class labels in order and, as rows, their mean vectors without the mean of all classes, ``scale`` long: a
    classifier without training. One aggregation; a row a class and dimension reaches the driver."""
    each = rows.select(F.col(label).alias("label"), F.posexplode(features).alias("dim", "v")).filter("label IS NOT NULL")
    found = each.groupBy("label", "dim").agg(F.avg("v").alias("v")).collect()
    labels = sorted({r["label"] for r in found})
    out = np.zeros((len(labels), 1 + max((r["dim"] for r in found), default=-1)))
    place = {c: i for i, c in enumerate(labels)}
    for r in found:
        out[place[r["label"]], r["dim"]] = r["v"]
    out -= out.mean(axis=0)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return labels, scale * out / np.where(norm > 0, norm, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: DataFrame, labels: list[str], base: np.ndarray, folds: int, rank: int = 4, steps: int = 20, rate: float = 0.5, seed: int = 1) -> list[Adapter]:
    """An adapter for each fold, learned from the rows (x, label, fold) of the other folds; all take their steps together.

    The same rows give the same adapters, however they are dealt: A begins at zero, B from a seed, sums are rounded.
    """
    kept = rows.filter(F.col("label").isin(labels)).select(F.col("x").cast("array<double>").alias("x"), F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    kept = held(kept.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(GROUPS)).cast("int")))
    rng = np.random.default_rng(seed)
    b0 = rng.normal(size=(rank, base.shape[1])) / np.sqrt(base.shape[1])
    models = [Adapter(labels, base, np.zeros((len(labels), rank)), b0.copy()) for _ in range(folds)]
    speed = [(np.zeros_like(m.a), np.zeros_like(m.b)) for m in models]
    shape = "part int, fold int, n long, g array<double>"
    for _ in range(steps):
        weights = [m.weights for m in models]

        def gradients(frames: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            sums: dict[tuple[int, int], list] = {}
            for f in frames:
                for part, same in f.groupby("part"):
                    x, y, fold = np.array(same["x"].tolist()), same["y"].to_numpy() - 1, same["fold"].to_numpy()
                    for k, w in enumerate(weights):
                        own = fold != k
                        if own.any():
                            p = _softmax(x[own] @ w.T)
                            p[np.arange(own.sum()), y[own]] -= 1
                            held_sum = sums.setdefault((int(part), k), [0, 0.0])
                            held_sum[0] += int(own.sum())
                            held_sum[1] = held_sum[1] + p.T @ x[own]
            for (part, k), (n, g) in sums.items():
                yield pd.DataFrame({"part": [part], "fold": [k], "n": [n], "g": [g.ravel()]})

        def add(f: pd.DataFrame) -> pd.DataFrame:
            f = f.assign(key=[np.round(g, 9).tobytes() for g in f["g"]]).sort_values("key")  # in one order, whoever comes first
            return pd.DataFrame({"part": [f["part"].iloc[0]], "fold": [f["fold"].iloc[0]], "n": [int(f["n"].sum())], "g": [np.sum(np.stack(f["g"].tolist()), axis=0)]})

        found = kept.mapInPandas(gradients, shape).groupBy("part", "fold").applyInPandas(add, shape).orderBy("part", "fold").collect()  # GROUPS a fold
        for k, m in enumerate(models):
            own = [r for r in found if r["fold"] == k]
            n = sum(r["n"] for r in own)
            if not n:
                continue
            g = np.round(np.sum([np.array(r["g"]) for r in own], axis=0) / n, 9).reshape(base.shape)
            down = (g @ m.b.T, m.a.T @ g)
            speed[k] = tuple(0.9 * v + d for v, d in zip(speed[k], down))
            m.a, m.b = m.a - rate * speed[k][0], m.b - rate * speed[k][1]
    return models


def predicted(weights: list[np.ndarray], labels: list[str], features: Column, fold: Column) -> Column:
    """The label of the largest score by the weights of a row's own fold, in the JVM."""
    rows = F.array(*[F.array(*[F.array(*[F.lit(round(float(v), 9)) for v in w]) for w in of]) for of in weights])
    score = lambda w: F.aggregate(F.zip_with(w, features.cast("array<double>"), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    scores = F.transform(F.get(rows, fold), score)
    return F.get(F.array(*map(F.lit, labels)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))
