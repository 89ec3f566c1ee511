"""Profiles and column reports."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabsmith.functions.columns import (
    col,
    finite,
    fractional_columns,
    numeric_columns,
    select_with,
    type_label,
)
from tabsmith.functions.stats import null_count, percent, share
from tabsmith.operators.dates import flexible_timestamp
from tabsmith.operators.frequency import distinct_counts
from tabsmith.operators.quantiles import exact_quantiles


def _explode(one: DataFrame, cells: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def missing_stats(df: DataFrame) -> DataFrame:
    """(column, missing, percent) for columns with nulls; one aggregate."""
    aggs = [null_count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("missing"),
            percent(F.col(f"n{i}"), F.col("rows")).alias("percent"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _explode(one, cells).filter("missing > 0")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """one row per column; number statistics are null for other types."""
    numbers = [c for c in columns if c in numeric_columns(df)]
    quarters = exact_quantiles(df, numbers, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(null_count(col(c)).alias(f"n{i}"))
        if c in numbers:
            v = col(c).cast("double")
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"av{i}"), F.stddev_samp(v).alias(f"sd{i}")]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    none = F.lit(None).cast("double")
    cells = []
    for i, c in enumerate(columns):
        q = quarters.get(c, [None] * 3)
        pick = lambda p: F.col(f"{p}{i}") if c in numbers else none
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(type_label(df.schema[c].dataType)).alias("dtype"),
                F.col("rows"),
                F.col(f"n{i}").alias("nulls"),
                pick("lo").alias("min"),
                pick("hi").alias("max"),
                pick("av").alias("mean"),
                pick("sd").alias("std"),
                F.lit(q[0]).cast("double").alias("q25"),
                F.lit(q[1]).cast("double").alias("median"),
                F.lit(q[2]).cast("double").alias("q75"),
            )
        )
    stats = _explode(one, cells)
    distinct = distinct_counts(df, columns).select("column", "distinct")
    return stats.join(F.broadcast(distinct), "column")  # one row per column


def profile(df: DataFrame) -> DataFrame:
    """column_stats for every column plus the missing percentage."""
    stats = column_stats(df, df.columns)
    return stats.withColumn("missing_percent", percent(F.col("nulls"), F.col("rows")))


def profile_extended(df: DataFrame) -> DataFrame:
    """zeros, negatives, infinities, uniqueness and outer quantiles."""
    fractions = fractional_columns(df)
    clean = select_with(df, {c: finite(col(c)) for c in fractions})
    numbers = numeric_columns(df)
    edges = exact_quantiles(clean, numbers, [0.05, 0.95])
    aggs = []
    for i, c in enumerate(df.columns):
        value = finite(col(c)) if c in fractions else col(c)
        aggs.append(F.count(value).alias(f"n{i}"))
        if c in numbers:
            aggs += [F.count(F.when(value == 0, 1)).alias(f"z{i}"), F.count(F.when(value < 0, 1)).alias(f"m{i}")]
        if c in fractions:
            aggs.append(F.count(F.when(F.abs(col(c)) == float("inf"), 1)).alias(f"i{i}"))
    one = df.agg(*aggs)
    none, none_d = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    cells = []
    for i, c in enumerate(df.columns):
        num = c in numbers
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("values"),
                (F.col(f"z{i}") if num else none).alias("zeros"),
                (F.col(f"m{i}") if num else none).alias("negatives"),
                (F.col(f"i{i}") if c in fractions else none).alias("infinities"),
                (F.lit(edges[c][0]).cast("double") if num else none_d).alias("q05"),
                (F.lit(edges[c][1]).cast("double") if num else none_d).alias("q95"),
            )
        )
    distinct = distinct_counts(clean, df.columns).select("column", "distinct")
    joined = _explode(one, cells).join(F.broadcast(distinct), "column")  # one row per column
    unique = F.try_divide(F.col("distinct").cast("double"), F.col("values"))
    return joined.withColumn("uniqueness", unique).withColumn("is_unique", F.col("distinct") == F.col("values"))


def infer_types(df: DataFrame, order: str | None = None, samples: int = 5) -> DataFrame:
    """Narrowest type that reads every non-null value, and early samples.

    Samples are the first non-null values by `order`, kept by a bounded
    per-column reduction rather than a sort of the table.
    """
    names = [c for c in df.columns if c != order]
    aggs = []
    for i, c in enumerate(names):
        text = F.trim(col(c).cast("string"))
        aggs += [
            F.count(col(c)).alias(f"n{i}"),
            F.count(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))).alias(f"int{i}"),
            F.count(F.when(text.rlike(r"\d"), finite(text.try_cast("double")))).alias(f"flt{i}"),
            F.count(flexible_timestamp(text)).alias(f"dt{i}"),
        ]
    one = df.agg(*aggs)
    cells = []
    for i, c in enumerate(names):
        n = F.col(f"n{i}")
        label = (
            F.when(n == 0, "string")
            .when(F.col(f"int{i}") == n, "integer")
            .when(F.col(f"flt{i}") == n, "float")
            .when(F.col(f"dt{i}") == n, "datetime")
            .otherwise("string")
        )
        declared = type_label(df.schema[c].dataType)
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                n.alias("values"),
                (label if declared == "string" else F.lit(declared)).alias("type"),
            )
        )
    typed = _explode(one, cells)
    if not order:
        return typed
    picked = first_values(df, names, order, samples)
    return typed.join(F.broadcast(picked), "column", "left")  # one row per column


def first_values(df: DataFrame, names: list[str], order: str, n: int) -> DataFrame:
    """(column, samples): first n non-null values by order, as text.

    One scan for all columns: a task keeps the n values with the smallest keys
    of each column and sends no more, so nothing is sorted. Rows without a key
    come first; rows of one key stand in no set order.
    """
    rows = df.select(col(order).alias("o"), *[col(c).alias(f"v{i}") for i, c in enumerate(names)])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in (T.StructField("i", T.IntegerType()), *rows.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            key = b.column(0)
            for i in range(len(names)):
                known = b.column(i + 1).is_valid()
                o, v = key.filter(known), b.column(i + 1).filter(known)
                if i in held:
                    if len(held[i][0]) == n and not o.null_count and len(o) and not held[i][0].null_count:
                        if pc.min(o).as_py() >= pc.max(held[i][0]).as_py():
                            continue
                    o, v = pa.concat_arrays([held[i][0], o]), pa.concat_arrays([held[i][1], v])
                first = pc.sort_indices(o, null_placement="at_start")[:n]
                held[i] = o.take(first), v.take(first)
        arrow = to_arrow_schema(schema)
        for i, (o, v) in held.items():
            if len(o):
                empty = [pa.nulls(len(o), f.type) for f in list(arrow)[2:]]
                empty[i] = v.cast(arrow.field(i + 2).type)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(o), pa.int32()), o.cast(arrow.field(1).type), *empty], schema=arrow)

    found = rows.mapInArrow(run, schema)
    text = F.coalesce(*[F.col(f"v{i}").cast("string") for i in range(len(names))])
    place = F.row_number().over(W.partitionBy("i").orderBy("o", "v"))
    top = found.select("i", "o", text.alias("v")).withColumn("place", place).filter(F.col("place") <= n)
    grouped = top.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("s"))
    return grouped.select(F.get(F.array(*map(F.lit, names)), F.col("i")).alias("column"), F.concat_ws("|", F.col("s.v")).alias("samples"))


def logical_type_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, boolean, datetime, numeric shares, logical type)."""
    aggs = []
    for i, c in enumerate(columns):
        text = col(c).cast("string")
        filled = F.when(text != "", text)
        shape = text.rlike(r"\d{4}|\d{2}[-/]\d{2}|\d{2}[-/]\d{4}")
        cleaned = F.regexp_replace(text, "[,$%]", "")
        leading = F.regexp_extract(cleaned, r"^\s*[+-]?(\d+\.?\d*|\.\d+)", 0)
        aggs += [
            F.coalesce(share(F.lower(filled).isin("true", "false", "yes", "no", "1", "0"), filled), F.lit(0.0)).alias(f"b{i}"),
            F.coalesce(share(shape & flexible_timestamp(filled).isNotNull(), filled), F.lit(0.0)).alias(f"d{i}"),
            F.coalesce(share(leading != "", filled), F.lit(0.0)).alias(f"n{i}"),
        ]
    one = df.agg(*aggs)
    cells = []
    for i, c in enumerate(columns):
        b, d, n = F.col(f"b{i}"), F.col(f"d{i}"), F.col(f"n{i}")
        declared = type_label(df.schema[c].dataType)
        kind = F.when(b > 0.8, "boolean").when(d > 0.7, "datetime").when(n > 0.8, "numeric").otherwise("categorical")
        if declared == "datetime":
            kind = F.lit("datetime")
        elif declared in ("integer", "float"):
            kind = F.when(F.lit(True), "numeric")
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.round(b, 4).alias("boolean_share"),
                F.round(d, 4).alias("datetime_share"),
                F.round(n, 4).alias("numeric_share"),
                kind.alias("logical_type"),
            )
        )
    return _explode(one, cells)


def quick_quality(df: DataFrame) -> DataFrame:
    """(kind, column, value): completeness, consistency and warnings."""
    kinds = {r["column"]: r["logical_type"] for r in logical_type_shares(df, df.columns).collect()}
    aggs, texts = [], [c for c in df.columns if kinds[c] == "categorical"]
    for i, c in enumerate(df.columns):
        filled = F.when(col(c).cast("string") != "", col(c))
        aggs.append(F.count(filled).alias(f"n{i}"))
        aggs.append(F.coalesce(F.min(filled) == F.max(filled), F.lit(False)).alias(f"s{i}"))
    one = df.agg(F.count("*").alias("rows"), *aggs)
    total = F.col("rows") * len(df.columns)
    filled_cells = sum((F.col(f"n{i}") for i in range(len(df.columns))), F.lit(0))
    completeness = F.coalesce(F.try_divide(filled_cells.cast("double"), total) * 100, F.lit(0.0))
    steady = sum(
        (
            F.when(F.col(f"n{i}") > 0, 1).otherwise(0) if kinds[c] in ("numeric", "datetime") else F.lit(1)
            for i, c in enumerate(df.columns)
        ),
        F.lit(0),
    )
    cell = lambda kind, column, value, keep: F.when(
        keep,
        F.struct(F.lit(kind).alias("kind"), F.lit(column).cast("string").alias("column"), F.round(value, 1).alias("value")),
    )
    cells = [
        cell("completeness", None, completeness, F.lit(True)),
        cell("consistency", None, steady.cast("double") / len(df.columns) * 100, F.lit(True)),
        cell("low completeness", None, completeness, completeness < 80),
    ]
    for i, c in enumerate(df.columns):
        missing = F.coalesce(F.try_divide(F.col("rows") - F.col(f"n{i}"), F.col("rows")) * 100, F.lit(0.0))
        cells.append(cell("mostly missing", c, missing, missing > 50))
        if c in texts:
            cells.append(cell("single value", c, F.lit(1.0), F.col(f"s{i}") & (F.col(f"n{i}") > 1)))
    return one.select(F.explode(F.array_compact(F.array(*cells))).alias("r")).select("r.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations in long form, from one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(col(a).cast("double"), col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("r")) for c in columns]
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")))
    return _explode(one, cells)


def value_balance(df: DataFrame, target: str) -> DataFrame:
    """rows per target class and their share."""
    counted = df.groupBy(col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counted.select("label", "n", percent(F.col("n"), F.lit(df.count())).alias("percent"))


def validate_source(df: DataFrame) -> DataFrame:
    """Rows, columns and names; an empty table is marked invalid."""
    return df.agg(F.count("*").alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(",".join(df.columns)).alias("names"),
        ((F.col("rows") > 0) & F.lit(len(df.columns) > 0)).alias("valid"),
    )
