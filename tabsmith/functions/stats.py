"""Aggregate expressions shared by profiling and feature rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def skew_g1(c: Column) -> Column:
    """Bias-adjusted skewness; null below three values, zero without spread."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c.cast("double"))
    g1 = F.when(g1.isNull() | F.isnan(g1), F.lit(0.0)).otherwise(g1)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def null_count(c: Column) -> Column:
    return F.count(F.when(c.isNull(), F.lit(1)))


def share(condition: Column, of: Column) -> Column:
    """Part of the non-null values of `of` that meet the condition; null if none."""
    hits = F.count(F.when(of.isNotNull() & condition, F.lit(1)))
    return F.try_divide(hits.cast("double"), F.count(of).cast("double"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, rounded half-even; null when the whole is zero."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def long_metrics(agg_row, entries):
    """One-row aggregate to (column, metric, value) rows.

    `entries` are (column, metric, name of the aggregate column).
    """
    cells = [
        F.struct(
            F.lit(column).alias("column"),
            F.lit(metric).alias("metric"),
            F.col(name).cast("double").alias("value"),
        )
        for column, metric, name in entries
    ]
    return agg_row.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
