"""Ordered work on series of any length.

A window partitioned by series alone gathers a hot series in one task. Here a
series is cut into chunks by approximate quantiles of the order column, so that
no window group exceeds about `chunk_rows`. What a chunk needs from its
neighbours (row offset, last value before, next value after) is one summary row
per (series, chunk), carried over a window on that small summary.

When the whole frame is no larger than `chunk_rows`, one chunk per series is
proven enough and the plain window is used; positions are the same either way.
Rows without an order key come first, among themselves by the hash of the row.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabsmith.functions.columns import col, order_value
from tabsmith.session import materialise

CHUNK_ROWS = 2_000_000
CHUNK = "_chunk"
POS = "_pos"


def with_chunks(df: DataFrame, order: str, chunk_rows: int | None = None, rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add `_chunk`, increasing with `order`; the flag tells if there are several.

    Rows with the same order value share a chunk, so callers merge duplicate
    keys first. `rows` saves the count where it is known.
    """
    chunk_rows = chunk_rows or CHUNK_ROWS
    n = df.count() if rows is None else rows
    if n <= chunk_rows:
        return df.withColumn(CHUNK, F.lit(0)), False
    pieces = -(-2 * n // chunk_rows)
    if isinstance(df.schema[order].dataType, T.StringType):
        # Texts have no quantile sketch: range-partition them and write the
        # result, so that the chunk of a row can not change on a retry.
        ranged = df.repartitionByRange(pieces, col(order)).withColumn(CHUNK, F.spark_partition_id())
        return materialise(ranged, "ranged"), True
    key = order_value(col(order), df.schema[order].dataType)
    probs = [i / pieces for i in range(1, pieces)]
    cuts = df.agg(F.percentile_approx(key, probs, 20 * pieces).alias("cuts")).first()["cuts"]
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_order", outputCol=CHUNK, handleInvalid="keep").transform(
        df.withColumn("_order", key)
    )
    return bucketed.withColumn(CHUNK, F.coalesce(F.col(CHUNK).cast("int"), F.lit(-1))).drop("_order"), True


def _within(by: list[str]) -> list[Column]:
    return [col(c) for c in by] + [F.col(CHUNK)]


def with_position(
    df: DataFrame, by: list[str], order: str, chunk_rows: int | None = None, rows: int | None = None
) -> DataFrame:
    """Add `_pos`, the zero-based position of a row in its series."""
    chunked, several = with_chunks(df, order, chunk_rows, rows)
    hashed = [col(f.name) for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tie = F.when(col(order).isNull(), F.xxhash64(*hashed))
    local = F.row_number().over(W.partitionBy(*_within(by)).orderBy(col(order), tie)).cast("bigint") - 1
    if not several:
        return chunked.withColumn(POS, local).drop(CHUNK)
    before = W.partitionBy(*[col(c) for c in by]).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    sizes = chunked.groupBy(*_within(by)).agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return _join_summary(chunked.withColumn(POS, local), offsets, by).withColumn(
        POS, F.col(POS) + F.col("_off")
    ).drop("_off", CHUNK)


def _join_summary(df: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Join on the null-safe series keys and the chunk."""
    renamed = summary.select(
        *[col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col(CHUNK).alias("_kc"),
        *[col(c) for c in summary.columns if c not in by and c != CHUNK],
    )
    on = F.col(CHUNK) == F.col("_kc")
    for i, c in enumerate(by):
        on = on & col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(renamed, on, "left").drop("_kc", *[f"_k{i}" for i in range(len(by))])


def neighbours(
    df: DataFrame, by: list[str], order: str, columns: list[str], chunk_rows: int | None = None, rows: int | None = None
) -> DataFrame:
    """Add `_pos` and, per column i, `_prev{i}` / `_next{i}`.

    Each is a struct (pos, value) of the nearest non-null row at or before /
    at or after the row; null at the ends.
    """
    rows = df.count() if rows is None else rows
    placed = with_position(df, by, order, chunk_rows, rows)
    chunked, several = with_chunks(placed, order, chunk_rows, rows)
    known = {
        c: F.when(col(c).isNotNull(), F.struct(F.col(POS).alias("pos"), col(c).alias("value")))
        for c in columns
    }
    group = W.partitionBy(*_within(by)).orderBy(POS)
    back, ahead = group.rowsBetween(W.unboundedPreceding, 0), group.rowsBetween(0, W.unboundedFollowing)
    local = chunked
    for i, c in enumerate(columns):
        local = local.withColumn(f"_prev{i}", F.last(known[c], ignorenulls=True).over(back))
        local = local.withColumn(f"_next{i}", F.first(known[c], ignorenulls=True).over(ahead))
    if not several:
        return local.drop(CHUNK)
    ends = chunked.groupBy(*_within(by)).agg(
        *[F.max_by(known[c], F.when(col(c).isNotNull(), F.col(POS))).alias(f"_l{i}") for i, c in enumerate(columns)],
        *[F.min_by(known[c], F.when(col(c).isNotNull(), F.col(POS))).alias(f"_f{i}") for i, c in enumerate(columns)],
    )
    over = W.partitionBy(*[col(c) for c in by]).orderBy(CHUNK)
    earlier, later = over.rowsBetween(W.unboundedPreceding, -1), over.rowsBetween(1, W.unboundedFollowing)
    carried = ends.select(
        *[col(c) for c in by],
        CHUNK,
        *[F.last(f"_l{i}", ignorenulls=True).over(earlier).alias(f"_cl{i}") for i in range(len(columns))],
        *[F.first(f"_f{i}", ignorenulls=True).over(later).alias(f"_cf{i}") for i in range(len(columns))],
    )
    joined = _join_summary(local, carried, by)
    for i in range(len(columns)):
        joined = joined.withColumn(f"_prev{i}", F.coalesce(f"_prev{i}", f"_cl{i}"))
        joined = joined.withColumn(f"_next{i}", F.coalesce(f"_next{i}", f"_cf{i}"))
    extra = [f"_cl{i}" for i in range(len(columns))] + [f"_cf{i}" for i in range(len(columns))]
    return joined.drop(CHUNK, *extra)


def over_preceding(
    df: DataFrame,
    by: list[str],
    order: str,
    reach: int,
    build,
    chunk_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Apply window expressions that look back at most `reach` rows.

    `build(window)` returns {name: Column} for an ordered window. Long series
    are cut into blocks of positions; the last `reach` rows of a block are
    repeated at the head of the next one, so lags and rolling frames are exact.
    """
    chunk_rows = chunk_rows or CHUNK_ROWS
    rows = df.count() if rows is None else rows
    placed = with_position(df, by, order, chunk_rows, rows)
    if rows <= chunk_rows:
        window = W.partitionBy(*[col(c) for c in by] or [F.lit(0)]).orderBy(POS)
        return placed.select("*", *[e.alias(n) for n, e in build(window).items()])
    size = max(chunk_rows // 2, reach)
    block = F.floor(F.col(POS) / size)
    tail = F.col(POS) % size >= size - reach
    copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = placed.withColumn("_halo", F.explode(copies)).withColumn("_block", block + F.col("_halo"))
    window = W.partitionBy(*[col(c) for c in by], F.col("_block")).orderBy(POS)
    done = spread.select("*", *[e.alias(n) for n, e in build(window).items()])
    return done.filter("_halo = 0").drop("_halo", "_block")


def running_total(
    df: DataFrame, by: list[str], order: str, value: str, name: str, chunk_rows: int | None = None, ties: list[str] = ()
) -> DataFrame:
    """Add the running sum of `value` in series order; rows of one key follow `ties`, which have to set them apart."""
    chunked, several = with_chunks(df, order, chunk_rows)
    frame = W.partitionBy(*_within(by)).orderBy(col(order), *[col(c) for c in ties]).rowsBetween(W.unboundedPreceding, 0)
    local = chunked.withColumn(name, F.sum(col(value)).over(frame))
    if not several:
        return local.drop(CHUNK)
    before = W.partitionBy(*[col(c) for c in by]).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    totals = chunked.groupBy(*_within(by)).agg(F.sum(col(value)).alias("_t"))
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    joined = _join_summary(local, offsets, by)
    return joined.withColumn(name, F.col(name) + F.col("_off")).drop("_off", CHUNK)
