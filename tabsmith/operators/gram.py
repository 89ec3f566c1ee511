"""Moments of many columns in one pass, and linear models solved from them.

A task adds up the products of its own rows about a common shift, Spark adds up
the tasks, and what comes to the driver is one matrix, as wide as the columns
and of the same size for any number of rows. Every linear model, for every
target at once, is then a small solve on that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass
class Moments:
    """Rows, means, and the sums of products of the centred columns."""

    n: int
    mean: np.ndarray
    cross: np.ndarray


def moments(rows: DataFrame, column: str, shift: list[float]) -> Moments:
    """Moments of an array column as long as `shift`, a rough middle that keeps the products small.

    Arrays of another length and with missing or non-finite values are left out.
    """
    width, middle = len(shift), np.array(shift, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            lists = b.column(0)
            x = lists.filter(pa.compute.equal(pa.compute.list_value_length(lists), width)).flatten()
            x = x.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) - middle
            x = x[np.isfinite(x).all(axis=1)]
            n, total, cross = n + len(x), total + x.sum(axis=0), cross + x.T @ x
        cells = np.concatenate([[float(n)], total, cross.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([cells], pa.list_(pa.float64()))], names=["cells"])

    parts = rows.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "cells array<double>")
    summed = parts.select(F.posexplode("cells").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    cells = np.zeros(1 + width + width * width)
    for r in summed:
        cells[r["i"]] = r["v"]
    n, total, cross = int(cells[0]), cells[1 : 1 + width], cells[1 + width :].reshape(width, width)
    if not n:
        return Moments(0, middle, cross)
    return Moments(n, middle + total / n, cross - np.outer(total, total) / n)


@dataclass(frozen=True)
class LinearFit:
    """A linear model with a penalty on its weights, never on its constant.

    The squared errors are summed for the ridge (`l1` zero) and halved and
    averaged for the lasso and what lies between, so `alpha` means what it
    means in common libraries. `alpha` zero is least squares; of many best
    solutions it is the shortest one in units of the features' spread.
    """

    alpha: float = 0.0
    l1: float = 0.0

    def solve(self, m: Moments, features: int) -> np.ndarray:
        """A row per target (the columns behind the features): the constant, then a weight per feature."""
        xx, xy = m.cross[:features, :features], m.cross[:features, features:]
        if not m.n:
            raise ValueError("no rows to fit on")
        if self.alpha == 0:
            unit = np.sqrt(np.diag(xx))
            unit = np.where(unit > 0, unit, 1.0)[:, None]
            weights = np.linalg.pinv(xx / unit / unit.T, rcond=1e-12, hermitian=True) @ (xy / unit) / unit
        elif self.l1 == 0:
            low = np.linalg.cholesky(xx + self.alpha * np.eye(features))
            weights = np.linalg.solve(low.T, np.linalg.solve(low, xy))
        else:
            weights = np.stack([self._descend(xx, y, m.n) for y in xy.T], axis=1)
        constant = m.mean[features:] - m.mean[:features] @ weights
        return np.concatenate([constant[:, None], weights.T], axis=1)

    def _descend(self, xx: np.ndarray, xy: np.ndarray, n: int, most: int = 20_000) -> np.ndarray:
        """Coordinate descent: each weight in turn is moved to its best value and cut towards zero."""
        step, rest = n * self.alpha * self.l1, np.diag(xx) + n * self.alpha * (1 - self.l1)
        w, pull = np.zeros(len(xy)), xy.copy()  # pull: products of the features with what is not explained yet
        scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
        for _ in range(most):
            moved = 0.0
            for j in np.flatnonzero(rest > 0):
                free = pull[j] + xx[j, j] * w[j]
                new = np.sign(free) * max(abs(free) - step, 0.0) / rest[j]
                if new != w[j]:
                    pull -= xx[:, j] * (new - w[j])
                    moved = max(moved, abs(new - w[j]) * scale[j])
                    w[j] = new
            if moved <= 1e-12 * max(np.abs(w * scale).max(), 1e-300):
                break
        return w
