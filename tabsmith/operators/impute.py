"""Missing-value imputation (D1-D3, D5-D11); neighbours are in neighbours.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabsmith.functions.columns import col, numeric_columns, select_with
from tabsmith.functions.stats import null_count
from tabsmith.operators.clean import UNKNOWN
from tabsmith.operators.frequency import modes
from tabsmith.operators.ordered import POS, neighbours, over_preceding
from tabsmith.operators.quantiles import medians


def fill_values(df: DataFrame, values: dict) -> DataFrame:
    """Nulls of a column become its frozen value."""
    changed = {}
    for c, v in values.items():
        if c in df.columns:
            kind = "double" if isinstance(v, float) else df.schema[c].dataType
            changed[c] = F.coalesce(col(c).cast(kind), F.lit(v).cast(kind))
    return select_with(df, changed)


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """The most frequent value, the smallest on a tie, else `Unknown`."""
    return fill_values(df, {c: m if m is not None else UNKNOWN for c, m in modes(df, columns).items()})


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """The exact median, 0 for a column without values."""
    return fill_values(df, {c: float(m or 0.0) for c, m in medians(df, columns).items()})


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """D3: the mean, 0 for a column without values."""
    row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return fill_values(df, {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(columns)})


def _series_fill(df, columns, order, by, build, chunk_rows, rows=None):
    """Fill nulls from the neighbours' structs; leftovers become 0."""
    marked = neighbours(df, by, order, columns, chunk_rows, rows)
    filled = {
        c: F.coalesce(col(c).cast("double"), build(F.col(f"_prev{i}"), F.col(f"_next{i}")), F.lit(0.0))
        for i, c in enumerate(columns)
    }
    return marked.select(*[filled.get(c, col(c)).alias(c) for c in df.columns])


def ffill(df, columns, order, by=(), limit=None, chunk_rows=None) -> DataFrame:
    """Last value before, at most `limit` rows back; leftovers 0."""
    near = lambda p: F.col(POS) - p["pos"] <= limit if limit else F.lit(True)
    return _series_fill(df, columns, order, list(by), lambda p, n: F.when(near(p), p["value"].cast("double")), chunk_rows)


def bfill(df, columns, order, by=(), limit=None, chunk_rows=None) -> DataFrame:
    """Next value after, at most `limit` rows ahead; leftovers 0."""
    near = lambda n: n["pos"] - F.col(POS) <= limit if limit else F.lit(True)
    return _series_fill(df, columns, order, list(by), lambda p, n: F.when(near(n), n["value"].cast("double")), chunk_rows)


def interpolate_linear(df, columns, order, by=(), chunk_rows=None, rows=None) -> DataFrame:
    """Linear by position, the nearest value at the ends; leftovers 0."""

    def line(p, n):
        pv, nv = p["value"].cast("double"), n["value"].cast("double")
        step = (nv - pv) * (F.col(POS) - p["pos"]) / (n["pos"] - p["pos"])
        return F.coalesce(F.when(n["pos"] > p["pos"], pv + step), pv, nv)

    return _series_fill(df, columns, order, list(by), line, chunk_rows, rows)


def _rolling(df, columns, order, by, window, chunk_rows, leftover, rows=None):
    frame = lambda w: w.rowsBetween(-(window - 1), 0)
    rolled = over_preceding(
        df, list(by), order, window - 1,
        lambda w: {f"_roll{i}": F.avg(col(c)).over(frame(w)) for i, c in enumerate(columns)},
        chunk_rows,
        rows,
    )
    filled = {c: F.coalesce(col(c).cast("double"), F.col(f"_roll{i}"), leftover) for i, c in enumerate(columns)}
    return rolled.select(*[filled.get(c, col(c)).alias(c) for c in df.columns])


def impute_rolling(df, columns, order, by=(), window=3, chunk_rows=None) -> DataFrame:
    """Mean of the values among this and the preceding rows; leftovers 0."""
    return _rolling(df, columns, order, by, window, chunk_rows, F.lit(0.0))


def impute_auto_ts(df, columns, order, by=(), chunk_rows=None, rows=None) -> DataFrame:
    """Rolling mean for short gaps, then interpolation, then the ends.

    Interpolation fills both ends from the nearest value, so only a series
    without any value is left for the final 0.
    """
    rows = df.count() if rows is None else rows
    short = _rolling(df, columns, order, by, 3, chunk_rows, F.lit(None).cast("double"), rows)
    return interpolate_linear(short, columns, order, by, chunk_rows, rows)


SERIES_METHODS = {
    "auto": impute_auto_ts,
    "interpolate": interpolate_linear,
    "ffill": ffill,
    "bfill": bfill,
}


def impute_by_config(df, order, by=(), config=None, method="auto", columns=None) -> tuple[DataFrame, DataFrame]:
    """A method per column; returns the frame and a report.

    Columns that share a method are filled together. The report is one
    aggregate before and one after: (column, method, missing_before,
    missing_after, filled).
    """
    config = config or {}
    columns = columns or [c for c in numeric_columns(df) if c != order and c not in by]
    before = df.agg(*[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    todo = {c: before[f"n{i}"] for i, c in enumerate(columns) if before[f"n{i}"]}
    plan: dict[tuple, list[str]] = {}
    for c in todo:
        chosen = config.get(c, {})
        name = chosen.get("method", method)
        plan.setdefault((name, int(chosen.get("window_size", 3)) if name == "rolling" else 0), []).append(c)
    out = df
    for (name, window), names in plan.items():
        if name in SERIES_METHODS:
            out = SERIES_METHODS[name](out, names, order, by)
        elif name == "rolling":
            out = impute_rolling(out, names, order, by, window)
        elif name == "mean":
            out = impute_mean(out, names)
        elif name == "median":
            out = impute_median(out, names)
        else:
            raise ValueError(f"unknown method {name!r}")
    used = {c: name for (name, _), names in plan.items() for c in names}
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(used[c]).alias("method"),
            F.lit(todo[c]).cast("bigint").alias("missing_before"),
            F.col(f"n{i}").alias("missing_after"),
            (F.lit(todo[c]) - F.col(f"n{i}")).alias("filled"),
        )
        for i, c in enumerate(used)
    ]
    if not cells:
        empty = "column string, method string, missing_before bigint, missing_after bigint, filled bigint"
        return out, df.sparkSession.createDataFrame([], empty)
    after = out.agg(*[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(used)])
    return out, after.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def impute_target(df: DataFrame, target: str, task: str) -> DataFrame:
    """The mean for regression, the mode for classification."""
    return impute_mean(df, [target]) if task == "regression" else impute_mode(df, [target])
