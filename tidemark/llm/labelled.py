"""Bounded label samples, and one-dimensional calibration, for the operators that learn from labels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

#: At most about so many labelled rows are learned from (9 bytes each are broadcast).
MAX_LABELS = 1_000_000


def labelled_rows(labels: DataFrame, label: str, *, mod: int, held_out: int, most: int = MAX_LABELS) -> DataFrame:
    """(doc_id, label) rows outside the held-out fold, one a doc_id. Beyond ``most`` rows each stays with probability most / rows, by a hash of its id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", mod) != held_out))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def label_arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bounded sample as sorted ids and their labels, to broadcast."""
    table = rows.toArrow()
    ids, labels = table.column("doc_id").to_numpy(), table.column("label").to_numpy().astype(np.int8)
    order = np.argsort(ids, kind="stable")
    return ids[order], labels[order]


def look_up(ids: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The label of each id, -1 where there is none."""
    keys, labels = known
    if not len(keys):
        return np.full(len(ids), -1, np.int8)
    at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
    return np.where(keys[at] == ids, labels[at], -1).astype(np.int8)


def id_array(column) -> np.ndarray:
    """The ids as int64; a null, which no label can name, becomes the smallest integer."""
    return column.cast("int64").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def platt(scored: DataFrame, *, value: str = "x", label: str = "label", bin_width: float = 0.002, most: float = 40.0) -> tuple[float, float]:
    """Slope and intercept of P(label) = sigmoid(slope * x + intercept), fitted to a histogram of at most 2 * most / bin_width bins a class."""
    binned = F.round(F.greatest(F.least(F.col(value), F.lit(most)), F.lit(-most)) / bin_width).cast("int")
    rows = scored.groupBy(binned.alias("bin"), label).count().collect()
    if not rows:
        return 0.0, 0.0
    x = np.array([r["bin"] * bin_width for r in rows])
    y = np.array([r[label] for r in rows], float)
    n = np.array([r["count"] for r in rows], float)
    return fit_sigmoid(x, y, n)


def fit_sigmoid(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression in one variable by damped Newton steps, on smoothed targets so that separable data stay finite."""
    pos, neg = float((n * y).sum()), float((n * (1 - y)).sum())
    centre, spread = float((n * x).sum() / n.sum()), 1.0
    spread = math.sqrt(float((n * (x - centre) ** 2).sum() / n.sum())) or 1.0
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = (x - centre) / spread
    w = np.array([0.0, math.log((pos + 1) / (neg + 1))])
    X = np.stack([z, np.ones_like(z)], 1)

    def loss(w: np.ndarray) -> float:
        s = X @ w
        return float((n * (np.logaddexp(0, s) - t * s)).sum() + 1e-3 * (w[0] ** 2))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -500, 500)))
        grad = X.T @ (n * (p - t)) + np.array([2e-3 * w[0], 0])
        hess = (X * (n * p * (1 - p) + 1e-9)[:, None]).T @ X + np.diag([2e-3, 1e-9])
        step, scale, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while scale > 1e-4 and loss(w - scale * step) > now:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))

