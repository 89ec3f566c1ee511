"""Exact quantiles (linear interpolation) that hold at any size, with the same bits at any size.

Up to EXACT_LIMIT values the built-in `percentile` is used: its per-column
buffer is then bounded. Above it, a sketch brackets each wanted rank, the rows
below the bracket are counted, and only values inside the bracket are grouped
and ranked. A bracket that is still too large is bracketed again, so no task
ever holds more than EXACT_LIMIT distinct values of a column.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tabsmith.functions.columns import col

EXACT_LIMIT = 1_000_000
SKETCH_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    limit: int = EXACT_LIMIT,
    accuracy: int = SKETCH_ACCURACY,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """{column: value per probability}; None for a column without values.

    `counts` gives the non-null values per column where they are known.
    """
    if not columns:
        return {}
    df = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    ids = [f"c{i}" for i in range(len(columns))]
    if counts is None:
        sizes = df.agg(*[F.count(c).alias(c) for c in ids]).first().asDict()
    else:
        sizes = {f"c{i}": counts[c] for i, c in enumerate(columns)}
    result: dict[str, list[float | None]] = {}
    small = [c for c in ids if 0 < sizes[c] <= limit]
    if small:
        row = df.agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in small]).first()
        result.update({c: list(row[c]) for c in small})
    wanted = []
    for c in ids:
        if sizes[c] > limit:
            for p in probs:
                r = p * (sizes[c] - 1)
                wanted += [(c, math.floor(r)), (c, math.ceil(r))]
    found = _order_statistics(df, wanted, sizes, limit, accuracy) if wanted else {}
    for c in ids:
        if sizes[c] > limit:
            result[c] = []
            for p in probs:
                r = p * (sizes[c] - 1)
                lo, hi = found[c, math.floor(r)], found[c, math.ceil(r)]
                # The arithmetic of `percentile`, so that a value on an edge falls the same way at any size.
                result[c].append(lo if lo == hi else (math.ceil(r) - r) * lo + (r - math.floor(r)) * hi)
    return {name: result.get(f"c{i}", [None] * len(probs)) for i, name in enumerate(columns)}


def _order_statistics(df, wanted, sizes, limit, accuracy):
    """{(column, zero-based rank): value} for ranks of large columns."""
    wanted = sorted(set(wanted))
    margin = 2.0 / accuracy
    probs: dict[str, list[float]] = {}
    for c, r in wanted:
        p = r / max(sizes[c] - 1, 1)
        probs.setdefault(c, []).extend([max(p - margin, 0.0), min(p + margin, 1.0)])
    # One sketch per column answers all of its ranks.
    aggs = [F.percentile_approx(c, ps, accuracy).alias(c) for c, ps in probs.items()]
    aggs += [F.min(c).alias(f"{c}_min") for c in probs] + [F.max(c).alias(f"{c}_max") for c in probs]
    row = df.agg(*aggs).first()
    bracket, place = {}, dict.fromkeys(probs, 0)
    for c, r in wanted:
        i = place[c]
        place[c] += 2
        bracket[c, r] = (
            row[f"{c}_min"] if probs[c][i] == 0.0 else row[c][i],
            row[f"{c}_max"] if probs[c][i + 1] == 1.0 else row[c][i + 1],
        )
    counts = df.agg(
        *[F.count(F.when(F.col(c) < a, 1)).alias(f"{c}_{r}_below") for (c, r), (a, b) in bracket.items()],
        *[F.count(F.when(F.col(c).between(a, b), 1)).alias(f"{c}_{r}_in") for (c, r), (a, b) in bracket.items()],
    ).first()
    found, ready = {}, []
    for (c, r), (a, b) in bracket.items():
        below, inside = counts[f"{c}_{r}_below"], counts[f"{c}_{r}_in"]
        if not below <= r < below + inside:
            # The sketch missed its bound; look in the side that holds the rank.
            side = F.col(c) < a if r < below else F.col(c) > b
            shift = 0 if r < below else below + inside
            size = below if r < below else sizes[c] - shift
            found[c, r] = _one(df.filter(side), c, r - shift, size, limit, accuracy)
        elif a == b:
            found[c, r] = a
        elif inside <= limit or inside >= sizes[c]:
            ready.append((c, r, a, b, r - below))
        else:
            found[c, r] = _one(df.filter(F.col(c).between(a, b)), c, r - below, inside, limit, accuracy)
    if ready:
        found.update(_rank_inside(df, ready))
    return found


def _one(df, c, rank, size, limit, accuracy):
    if size <= limit:
        return _rank_inside(df, [(c, rank, None, None, rank)])[c, rank]
    return _order_statistics(df, [(c, rank)], {c: size}, limit, accuracy)[c, rank]


def _rank_inside(df, ready):
    """Ranks within brackets; equal values are merged before they are ranked."""
    parts = []
    for i, (c, _, a, b, _) in enumerate(ready):
        rows = df.select(F.lit(i).alias("t"), F.col(c).alias("v")).filter(F.col("v").isNotNull())
        parts.append(rows if a is None else rows.filter(F.col("v").between(a, b)))
    counted = reduce(DataFrame.unionAll, parts).groupBy("t", "v").agg(F.count("*").alias("n"))
    offset = F.create_map(*[F.lit(x) for i, t in enumerate(ready) for x in (i, t[4])])
    upto = F.sum("n").over(W.partitionBy("t").orderBy("v"))
    hit = counted.withColumn("upto", upto).filter(
        (F.col("upto") > offset[F.col("t")]) & (F.col("upto") - F.col("n") <= offset[F.col("t")])
    )
    return {(ready[x["t"]][0], ready[x["t"]][1]): x["v"] for x in hit.collect()}


def medians(df: DataFrame, columns: list[str], counts: dict[str, int] | None = None) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5], counts=counts).items()}


def quartiles(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    return {c: tuple(v) for c, v in exact_quantiles(df, columns, [0.25, 0.75]).items()}
