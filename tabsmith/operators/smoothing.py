"""Additive smoothing of series of any length by an associative scan.

A step of an additive smoother moves its state by an affine map, and its error
is affine in the state. So a block of values is a matrix that moves the state
(with a one behind it) across the block, and a quadratic form that gives the
block's squared error for any state before it. Two blocks that follow each
other are one of the same kind:

    move = second.move @ first.move
    cost = first.cost + first.move' @ second.cost @ first.move

All blocks of all series are reduced side by side, then joined in a tree. The
first block of a series knows its start, so its move forgets what was before.
All settings of a smoother's grid are carried along together.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabsmith.operators.ordered import POS, with_position

#: Values of a block, and blocks that are joined at a time.
BLOCK, FAN = 100_000, 16


class Smoother:
    """A grid of settings; `step` moves states of shape (settings, size, k) and returns the errors (settings, k).

    The last of the k columns takes the value; the others are the states that
    a block can start from.
    """

    def __init__(self, *axes: list[float]):
        cells = np.meshgrid(*axes, indexing="ij") if axes else [np.ones(1)]
        self.grid = [c.ravel()[:, None] for c in cells]
        self.settings = len(self.grid[0])

    size = 1
    #: Values that a series needs to be fitted at all, and that its start looks at.
    least = looks = 1

    def start(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """State (settings, size) from the first values, and how many of them it has used up."""
        raise NotImplementedError

    def step(self, s: np.ndarray, x: np.ndarray, i: int) -> np.ndarray:
        raise NotImplementedError

    def turned(self, s: np.ndarray, steps: int) -> np.ndarray:
        """The state in the order that the next block begins with."""
        return s

    def fold(self, x: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(move, cost) of a block of values (rows, columns)."""
        size, k = self.size, self.size + 1
        move, cost = np.zeros((self.settings, k, k)), np.zeros((self.settings, k, k))
        move[:, size, size] = 1.0
        if first:
            known, used = self.start(x)
            s = known[:, :, None].copy()
            squares = np.zeros(self.settings)
            for i, row in enumerate(x[used:]):
                error = self.step(s, row[:, None], i)
                squares += (error**2).reshape(self.settings, -1).sum(axis=1)
            move[:, :size, size] = self.turned(s, max(len(x) - used, 0))[:, :, 0]
            cost[:, size, size] = squares
            return move, cost
        s = np.zeros((self.settings, size, k))
        s[:, np.arange(size), np.arange(size)] = 1.0
        value = np.zeros((x.shape[1], k))
        for i, row in enumerate(x):
            value[:, size] = row
            error = self.step(s, value, i)
            cost += np.einsum("pj,pk->pjk", error, error) if error.ndim == 2 else np.einsum("pcj,pck->pjk", error, error)
        move[:, :size] = self.turned(s, len(x))
        return move, cost


class Level(Smoother):
    """Simple smoothing; with several columns each is smoothed by itself."""

    def __init__(self, alphas: list[float], columns: int = 1):
        super().__init__(alphas)
        self.size = columns

    def start(self, x):
        return np.repeat(x[:1], self.settings, axis=0), 1

    def step(self, s, x, i):
        error = x[None] - s
        s += self.grid[0][:, :, None] * error
        return error


class Trend(Smoother):
    """Level and additive trend."""

    size = looks = 2

    def start(self, x):
        slope = x[1, 0] - x[0, 0] if len(x) > 1 else 0.0
        return np.repeat([[x[0, 0], slope]], self.settings, axis=0), 1

    def step(self, s, x, i):
        alpha, beta = self.grid
        ahead = s[:, 0] + s[:, 1]
        error = x[0] - ahead
        s[:, 0] = ahead + alpha * error
        s[:, 1] += alpha * beta * error
        return error


class Season(Smoother):
    """Level, trend and an additive cycle of `period` values, the next one first."""

    def __init__(self, period: int, *axes: list[float]):
        super().__init__(*axes)
        self.period, self.size = period, 2 + period
        self.least = self.looks = 2 * period

    def start(self, x):
        m = self.period
        one = x[:m, 0].mean()
        two = x[m : 2 * m, 0].mean() if len(x) >= 2 * m else one
        return np.repeat([[one, (two - one) / m, *(x[:m, 0] - one), *[0.0] * (m - len(x))]], self.settings, axis=0), m

    def step(self, s, x, i):
        alpha, beta, gamma = self.grid
        slot = 2 + i % self.period
        season, ahead = s[:, slot], s[:, 0] + s[:, 1]
        error = x[0] - ahead - season
        level = alpha * (x[0] - season) + (1 - alpha) * ahead
        s[:, 1] = beta * (level - s[:, 0]) + (1 - beta) * s[:, 1]
        s[:, slot] = gamma * (x[0] - level) + (1 - gamma) * season
        s[:, 0] = level
        return error

    def turned(self, s, steps):
        return np.concatenate([s[:, :2], np.roll(s[:, 2:], -(steps % self.period), axis=1)], axis=1)


def smoothed(points: DataFrame, smoother: Smoother, columns: list[str] = ("value",), block: int = BLOCK) -> DataFrame:
    """(series, n, setting, state, sse): the setting with the least squared error of each series, and its last state.

    `points` are (series, pos, columns); rows with a missing value are passed
    over. Of equally good settings the first of the grid is taken. Series with
    fewer than the smoother's least values are left out.
    """
    if block < smoother.looks:
        raise ValueError("a block has to hold what a series starts from")
    kind, names = points.schema["series"].dataType.simpleString(), list(columns)
    gap = F.exists(F.array(*[F.col(c).isNull() for c in names]), lambda g: g)
    facts = points.agg(F.max("pos").alias("last"), F.count(F.when(gap, 1)).alias("gaps")).first()
    whole = points.select("series", "pos", *names)
    if facts["gaps"]:
        kept = whole.filter(~gap)
        whole = with_position(kept, ["series"], "pos").select("series", F.col(POS).alias("pos"), *names)
    blocks = ((facts["last"] or 0) // block) + 1
    k, settings = smoother.size + 1, smoother.settings
    table = f"series {kind}, b bigint, n bigint, move array<double>, cost array<double>"

    def reduce_block(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")[names].to_numpy(float)
        move, cost = smoother.fold(x, key[1] == 0)
        return pd.DataFrame({"series": [key[0]], "b": [key[1]], "n": [len(x)], "move": [move.ravel()], "cost": [cost.ravel()]})

    def join_blocks(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        move, cost = np.eye(k)[None].repeat(settings, axis=0), np.zeros((settings, k, k))
        for m, c in zip(pdf["move"], pdf["cost"]):
            m, c = np.reshape(m, (settings, k, k)), np.reshape(c, (settings, k, k))
            cost = cost + move.transpose(0, 2, 1) @ c @ move
            move = m @ move
        return pd.DataFrame({"series": [key[0]], "b": [key[1]], "n": [pdf["n"].sum()], "move": [move.ravel()], "cost": [cost.ravel()]})

    def best(batches):
        for pdf in batches:
            rows = []
            for series, n, move, cost in zip(pdf["series"], pdf["n"], pdf["move"], pdf["cost"]):
                sse = np.reshape(cost, (settings, k, k))[:, -1, -1]
                at = int(np.argmin(np.where(np.isnan(sse), np.inf, sse)))
                state = np.reshape(move, (settings, k, k))[at, :-1, -1]
                rows.append((series, n, [float(g[at, 0]) for g in smoother.grid], state.tolist(), float(sse[at])))
            yield pd.DataFrame(rows, columns=["series", "n", "setting", "state", "sse"])

    numbered = whole.withColumn("b", F.floor(F.col("pos") / block))
    found = numbered.groupBy("series", "b").applyInPandas(reduce_block, table)
    while blocks > 1:
        found = found.withColumn("up", F.floor(F.col("b") / FAN)).groupBy("series", "up").applyInPandas(join_blocks, table)
        blocks = -(-blocks // FAN)
    found = found.filter(F.col("n") >= smoother.least).drop("b")
    return found.mapInPandas(best, f"series {kind}, n bigint, setting array<double>, state array<double>, sse double")
