"""Value-frequency table: one unpivot and one hash aggregate per type family.

A value held by many rows is merged before the shuffle (partial aggregation),
so a hot value costs no more than a rare one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tabsmith.functions.columns import col, is_numeric

DIGEST_LENGTH = 64


def _families(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    families: dict[str, list[str]] = {}
    for name in columns:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.IntegralType):
            key = "bigint"
        elif is_numeric(dtype):
            key = "double"
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            key = "timestamp"
        else:
            key = "string"
        families.setdefault(key, []).append(name)
    return families


def _stacked(df: DataFrame, names: list[str], kind: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("column"), col(n).cast(kind).alias("value")) for n in names]
    rows = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")
    return rows.filter(F.col("value").isNotNull())


def _counted(df: DataFrame, columns: list[str]) -> list[DataFrame]:
    """One typed (column, value, n) frame per type family."""
    return [
        _stacked(df, names, kind).groupBy("column", "value").agg(F.count("*").alias("n"))
        for kind, names in _families(df, columns).items()
    ]


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text, n) for every non-null value."""
    text = F.col("value").cast("string").alias("value")
    return reduce(DataFrame.unionAll, [c.select("column", text, "n") for c in _counted(df, columns)])


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct, top_count, counted); long texts travel as digests."""
    parts = []
    for kind, names in _families(df, columns).items():
        rows = _stacked(df, names, kind)
        if kind == "string":
            long_text = F.length("value") > DIGEST_LENGTH
            rows = rows.withColumn("value", F.when(long_text, F.sha2("value", 256)).otherwise(F.col("value")))
        counted = rows.groupBy("column", "value").agg(F.count("*").alias("n"))
        parts.append(
            counted.groupBy("column").agg(
                F.count("*").alias("distinct"), F.max("n").alias("top_count"), F.sum("n").alias("counted")
            )
        )
    seen = reduce(DataFrame.unionAll, parts)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    zero = F.lit(0).cast("bigint")
    return names.join(seen, "column", "left").select(
        "column",
        F.coalesce("distinct", zero).alias("distinct"),
        F.coalesce("top_count", zero).alias("top_count"),
        F.coalesce("counted", zero).alias("counted"),
    )


def distinct_dict(df: DataFrame, columns: list[str]) -> dict[str, int]:
    return {r["column"]: r["distinct"] for r in distinct_counts(df, columns).collect()} if columns else {}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, the smallest one on a tie; one row each."""
    if not columns:
        return {}
    first = F.min_by(F.col("value").cast("string"), F.struct(-F.col("n"), F.col("value")))
    best = reduce(
        DataFrame.unionAll,
        [c.groupBy("column").agg(first.alias("value")) for c in _counted(df, columns)],
    )
    found = {r["column"]: r["value"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most common non-null values with their rank."""
    counted = value_counts(df, [column]).select("value", F.col("n").alias("count"))
    top = counted.orderBy(F.desc("count"), F.asc("value")).limit(n)
    rank = F.row_number().over(W.orderBy(F.desc("count"), F.asc("value")))  # at most n rows
    return top.select(rank.alias("rank"), "value", "count")


def categories(df: DataFrame, columns: list[str], most: int | None) -> dict[str, list[str]]:
    """Sorted values of the columns that have at most `most` distinct ones; of all columns without it.

    A sketch first removes columns far above the bound, so the exact pass
    only touches low-cardinality columns and the driver receives a bounded list.
    """
    if not columns:
        return {}
    low = columns
    if most is not None:
        rough = df.agg(*[F.approx_count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        low = [c for i, c in enumerate(columns) if rough[f"c{i}"] <= 2 * most + 10]
    if not low:
        return {}
    exact = [F.array_sort(F.collect_set(col(c).cast("string"))).alias(f"c{i}") for i, c in enumerate(low)]
    rows = df.agg(*exact).first()
    return {c: list(rows[f"c{i}"]) for i, c in enumerate(low) if most is None or len(rows[f"c{i}"]) <= most}
