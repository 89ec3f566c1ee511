"""Data behind charts (H1-H7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tabsmith.functions.columns import col, date_columns, numeric_columns
from tabsmith.functions.stats import null_count
from tabsmith.operators.frequency import distinct_counts
from tabsmith.operators.profile import first_values


def bar(df: DataFrame, x: str, y: str) -> DataFrame:
    """H1: mean of y per x, ordered by x; null keys are left out."""
    kept = df.filter(col(x).isNotNull())
    return kept.groupBy(col(x).alias("label")).agg(F.avg(col(y)).alias("value")).orderBy("label")


def pie(df: DataFrame, category: str, value: str) -> DataFrame:
    """H2: sum of value per category."""
    kept = df.filter(col(category).isNotNull())
    return kept.groupBy(col(category).alias("label")).agg(F.sum(col(value)).alias("value"))


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """H3: complete pairs in order of x (range-partitioned sort)."""
    return scatter(df, x, y).orderBy("x", "y")


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """H4: complete pairs."""
    return df.select(col(x).alias("x"), col(y).alias("y")).na.drop()


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """H5: equal-width bins, the last one closed; empty bins are kept.

    The counts are one aggregate of `bins` slots, so no join with the bin list
    and no shuffle of rows is needed.
    """
    value = col(x).cast("double")
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if edge["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, label string, n bigint")
    lo, hi = edge["lo"], edge["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    edges = [lo + i * width for i in range(bins)] + [hi]
    place = F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counted = df.filter(value.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    labels = df.sparkSession.createDataFrame(
        [(i, f"{edges[i]:.2f}-{edges[i + 1]:.2f}") for i in range(bins)], "bin int, label string"
    )
    return labels.join(counted, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def chart_columns(df: DataFrame, order: str | None = None) -> DataFrame:
    """H6: per column its category, distinct and null counts, range and use."""
    numbers, dates = numeric_columns(df), date_columns(df)
    aggs = []
    for i, c in enumerate(df.columns):
        aggs.append(null_count(col(c)).alias(f"n{i}"))
        if c in numbers:
            v = col(c).cast("double")
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"av{i}")]
    none = F.lit(None).cast("double")
    cells = []
    for i, c in enumerate(df.columns):
        num = c in numbers
        kind = "numeric" if num else "datetime" if c in dates else "categorical"
        cells.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(kind).alias("category"),
                F.col(f"n{i}").alias("nulls"),
                (F.col(f"lo{i}") if num else none).alias("min"),
                (F.col(f"hi{i}") if num else none).alias("max"),
                (F.col(f"av{i}") if num else none).alias("mean"),
            )
        )
    facts = df.agg(*aggs).select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    distinct = distinct_counts(df, df.columns).select("column", "distinct")
    joined = facts.join(F.broadcast(distinct), "column")  # one row per column
    groupable = F.when(F.col("category") == "categorical", F.col("distinct") <= 20)
    joined = joined.withColumn("groupable", groupable)
    if order is None:
        return joined
    return joined.join(F.broadcast(first_values(df, df.columns, order, 5)), "column", "left")


def suggest_charts(catalogue: DataFrame, most: int = 10) -> DataFrame:
    """H7: chart suggestions per dataset from its H6 rows (key `dataset`).

    Only the first few columns of each category can take part, so each dataset
    contributes a short array; the pairs are formed inside that row.
    """
    place = F.row_number().over(W.partitionBy("dataset", "category").orderBy("position"))
    short = catalogue.withColumn("place", place).filter(F.col("place") <= 4)
    cell = F.struct("position", "column", "distinct")
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("category") == kind, cell)))
    wide = short.groupBy("dataset").agg(
        pick("numeric").alias("num"), pick("categorical").alias("cat"), pick("datetime").alias("day")
    )

    def crossed(kind, left, right, keep=None):
        rows = F.filter(left, keep) if keep else left
        return F.flatten(
            F.transform(rows, lambda a: F.transform(right, lambda b: _chart(kind, a["column"], b["column"])))
        )

    num, cat, day = F.col("num"), F.slice("cat", 1, 3), F.slice("day", 1, 2)
    num3 = F.slice(num, 1, 3)
    scatter_pairs = F.flatten(
        F.transform(
            num3,
            lambda a, i: F.transform(
                F.filter(num, lambda b, j: j > i), lambda b: _chart("scatter", a["column"], b["column"])
            ),
        )
    )
    bars = crossed("bar", cat, num3, lambda a: a["distinct"] <= 15)
    lines = crossed("line", day, num3)
    pies = crossed("pie", cat, F.slice(num, 1, 1), lambda a: (a["distinct"] >= 2) & (a["distinct"] <= 10))
    every = F.concat(bars, scatter_pairs, lines, pies)
    listed = wide.select("dataset", F.posexplode(F.slice(every, 1, most)).alias("i", "c"))
    return listed.select("dataset", (F.col("i") + 1).alias("rank"), "c.chart", "c.x", "c.y")


def _chart(kind, x, y):
    return F.struct(F.lit(kind).alias("chart"), x.alias("x"), y.alias("y"))
