"""Isolation forest: rows that random cuts part from the others early.

Trees are grown on the driver from a bounded sample and are plain data: arrays
of features, cuts, children and leaf sizes. A row's score comes from its mean
path through all trees, worked out for whole batches of rows; nothing of the
forest grows with the table.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabsmith.functions.columns import col, finite
from tabsmith.operators.quantiles import exact_quantiles

#: Different rows that the trees draw from at most.
POOL = 8192


@dataclass
class Tree:
    """Node i cuts `feature[i]` at `cut[i]`: rows below go to `low[i]`, others to `high[i]`; a leaf has feature -1 and its path's length."""

    feature: list[int]
    cut: list[float]
    low: list[int]
    high: list[int]
    length: list[float]


@dataclass
class Forest:
    columns: list[str]
    fill: list[float]
    size: int
    trees: list[Tree]


def usual_path(n: int) -> float:
    """The mean path to one of n rows parted by random cuts."""
    if n < 2:
        return 0.0
    return 2.0 * sum(1.0 / i for i in range(1, n)) - 2.0 * (n - 1) / n


def _grow(rows: list[tuple], rng: random.Random, deepest: int) -> Tree:
    tree = Tree([], [], [], [], [])

    def node(held: list[tuple], depth: int) -> int:
        at = len(tree.feature)
        for values in (tree.feature, tree.low, tree.high):
            values.append(-1)
        tree.cut.append(0.0)
        tree.length.append(depth + usual_path(len(held)))
        ends = [(min(x), max(x)) for x in zip(*held)] if depth < deepest and len(held) > 1 else []
        uneven = [f for f, (a, b) in enumerate(ends) if a < b]
        if uneven:
            f = rng.choice(uneven)
            cut = rng.uniform(*ends[f])
            cut = cut if cut > ends[f][0] else ends[f][1]  # a cut at the lowest value would part nothing
            tree.feature[at], tree.cut[at] = f, cut
            tree.low[at] = node([r for r in held if r[f] < cut], depth + 1)
            tree.high[at] = node([r for r in held if r[f] >= cut], depth + 1)
        return at

    node(rows, 0)
    return tree


def fit_forest(df: DataFrame, columns: list[str], trees: int = 100, size: int = 256, seed: int = 123) -> Forest:
    """Grow the trees from a sample of the table.

    The pool are up to POOL different rows, picked by a hash of their values;
    every tree draws `size` of them by how often they occur, so copies count
    and reruns agree on any partitioning. Missing and non-finite values take
    the column's mean.
    """
    numbers = [finite(col(c).cast("double")) for c in columns]
    means = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(numbers)]).first()
    # Rounded, so that the order of the sums leaves no trace.
    fill = [float(f"{m:.12g}") if m is not None else 0.0 for m in means]
    row = F.array(*[F.coalesce(x, F.lit(m)) for x, m in zip(numbers, fill)])
    counted = df.select(row.alias("x")).groupBy("x").agg(F.count("*").alias("w"))
    pool = counted.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(POOL).collect()
    held, weights = [tuple(r["x"]) for r in pool], [r["w"] for r in pool]
    taken = min(size, sum(weights))
    rng, deepest = random.Random(seed), max(1, math.ceil(math.log2(max(taken, 2))))
    grown = [_grow(rng.choices(held, weights, k=taken), rng, deepest) for _ in range(trees)] if held else []
    return Forest(list(columns), fill, taken, grown)


def isolation_score(forest: Forest) -> Column:
    """Above a half: a row that is parted earlier than usual; near one: almost at once."""
    trees = [(np.array(t.feature), np.array(t.cut), np.array([t.low, t.high]), np.array(t.length)) for t in forest.trees]
    fill, usual = forest.fill, usual_path(forest.size)

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        x = np.stack([v.to_numpy(float, na_value=np.nan) for v in values], axis=1)
        x = np.where(np.isfinite(x), x, fill)
        path = np.zeros(len(x))
        for feature, cut, sides, length in trees:
            node = np.zeros(len(x), int)
            open_rows = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, int)
            while len(open_rows):
                at = node[open_rows]
                node[open_rows] = sides[(x[open_rows, feature[at]] >= cut[at]).astype(int), at]
                open_rows = open_rows[feature[node[open_rows]] >= 0]
            path += length[node]
        mean = path / max(len(trees), 1)
        return pd.Series(np.power(2.0, -mean / usual) if usual else np.full(len(x), 0.5))

    return score(*[col(c).cast("double") for c in forest.columns])


def trim_isolated_rows(
    df: DataFrame, columns: list[str], fraction: float = 0.05, trees: int = 100, size: int = 256, seed: int = 123
) -> DataFrame:
    """Drop the given share of rows that are most easily isolated; rows at the cut stay."""
    if not 0 < fraction <= 0.2:
        raise ValueError("fraction must lie in (0, 0.2]")
    forest = fit_forest(df, columns, trees, size, seed)
    # The same digits on a rerun decide, whatever the order of the sums.
    scored = df.select("*", F.round(isolation_score(forest), 9).alias("_isolation"))
    cut = exact_quantiles(scored.select("_isolation"), ["_isolation"], [1 - fraction])["_isolation"][0]
    return df if cut is None else scored.filter(F.col("_isolation") <= F.lit(cut)).drop("_isolation")
