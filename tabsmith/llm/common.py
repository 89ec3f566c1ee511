"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A word: what ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"


def c(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text with null as empty."""
    return F.coalesce(c(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hex_digits(rows: int, per_bucket: int = 1 << 16) -> int:
    """Digits of a hexadecimal hash that cut `rows` into buckets of about `per_bucket`."""
    return max(1, math.ceil(math.log(max(rows, 1) / per_bucket, 16))) if rows > per_bucket else 1


def before(df: DataFrame, by: list[str], key: str, value: Column, name: str, rows: int) -> DataFrame:
    """Add the sum of `value` over the rows of the same `by` that come earlier.

    The order is that of `key`, a hexadecimal hash, then of all other columns.
    A group is cut into buckets of leading digits; bucket totals carry the
    offsets, so a hot group is spread over many tasks. `by` holds no nulls and
    `df` has to be written already, for it is read twice.
    """
    digits = hex_digits(rows)
    cut = df.withColumn("_bucket", F.substring(c(key), 1, digits)).withColumn("_value", value)
    ties = [c(x) for x in df.columns if x not in by and x != key]
    local = W.partitionBy(*[c(x) for x in by], "_bucket").orderBy(c(key), *ties).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*[c(x) for x in by]).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*[c(x) for x in by], "_bucket").agg(F.sum("_value").alias("_total"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    placed = cut.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    return (
        placed.join(offsets, [*by, "_bucket"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_bucket", "_value", "_local", "_offset")
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in small batches, which bounds what a Python worker holds at once."""
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)
