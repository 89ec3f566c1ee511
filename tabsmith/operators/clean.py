"""Projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabsmith.functions.columns import (
    col,
    finite,
    fractional_columns,
    is_numeric,
    numeric_columns,
    quote,
    select_with,
    string_columns,
)
from tabsmith.functions.stats import null_count
from tabsmith.operators.quantiles import exact_quantiles, medians, quartiles

# Texts that mean "missing" in tables.
TABLE_NULL_TOKENS = [
    "na", "n/a", "N/A", "NAN", "NA", "Null", "null", "NULL", "Nan", "nan", "-", "--", "---", "----",
    "", " ", "  ", "   ", "    ", "?", "??", "???", "????", "#N/A", "#NA", "nil", "NIL", "NaN", "####",
]

# Texts that mean "missing" in time series.
SERIES_NULL_TOKENS = [
    "na", "n/a", "N/A", "NAN", "nan", "NA", "Null", "null", "NULL", "Nan", "Unknown", "unknown", "UNKNOWN",
    "", "-", "--", "---", "----", " ", "  ", "   ", "    ", "?", "??", "???", "????",
    "Missing", "missing", "MISSING", "None",
]

# Name parts that hint at a leaked target.
LEAK_HINTS = ["_encoded", "_scaled", "_transformed", "_norm", "onehot", "target_"]

UNKNOWN = "Unknown"


def null_tokens(df: DataFrame, tokens: list[str] = TABLE_NULL_TOKENS) -> DataFrame:
    """B1: text equal to a token becomes null (exact, case-sensitive)."""
    return select_with(
        df, {c: F.when(~col(c).isin(tokens), col(c)) for c in string_columns(df)}
    )


def blank_to_null(df: DataFrame) -> DataFrame:
    """B2: empty or whitespace-only text becomes null."""
    return select_with(df, {c: F.when(col(c).rlike(r"\S"), col(c)) for c in string_columns(df)})


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is null."""
    some = F.coalesce(*[F.when(col(c).isNotNull(), F.lit(True)) for c in df.columns], F.lit(False))
    return df.filter(some)


def empty_row_count(df: DataFrame) -> DataFrame:
    """B3 report: rows before, rows dropped."""
    some = F.coalesce(*[F.when(col(c).isNotNull(), F.lit(True)) for c in df.columns], F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count(F.when(~some, 1)).alias("dropped"))


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and nulls per column from one aggregate."""
    aggs = [null_count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    row = df.agg(F.count("*").alias("rows"), *aggs).first()
    return row["rows"], {c: row[f"n{i}"] for i, c in enumerate(df.columns)}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value."""
    aggs = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*aggs).first()
    return df.select(*[col(c) for i, c in enumerate(df.columns) if row[f"n{i}"] > 0])


def rename_by_position(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns with the same name."""
    first: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        first.setdefault(name, i)
    flat = rename_by_position(df)
    return flat.select(*[F.col(f"_{i}").alias(name) for name, i in first.items()])


def require_unique_columns(df: DataFrame) -> DataFrame:
    """B5, strict: training refuses duplicate names."""
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if twice:
        raise ValueError(f"duplicate column names: {', '.join(twice)}")
    return df


def sparse_columns(df: DataFrame, threshold: float = 0.95) -> list[str]:
    rows, nulls = null_counts(df)
    return [c for c in df.columns if nulls[c] > threshold * rows]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Drop columns whose nulls exceed the threshold (strictly)."""
    return df.drop(*sparse_columns(df, threshold))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value; min and max decide without a shuffle."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs.append((F.count(col(c)) == 0).alias(f"e{i}"))
        aggs.append((F.min(col(c)) == F.max(col(c))).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(df.columns) if row[f"e{i}"] or row[f"s{i}"]]


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Drop columns with at most one distinct non-null value."""
    return df.drop(*constant_columns(df))


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the named columns; unknown names are ignored."""
    return df.select(*[col(c) for c in df.columns if c not in set(names)])


def align_columns(df: DataFrame, expected: list[str] | dict[str, str], strict: bool = False) -> DataFrame:
    """The expected columns in order; missing ones are null, extra ones go.

    `expected` may give the type of each column, so a missing one is typed.
    """
    types = expected if isinstance(expected, dict) else dict.fromkeys(expected, "string")
    missing = [c for c in types if c not in df.columns]
    if strict and missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(
        *[col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    )


def select_features(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The features and the target; unknown names are an error."""
    unknown = [c for c in [*features, target] if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*[col(c) for c in dict.fromkeys([*features, target])])


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Drop saved row indexes (names with `Unnamed`)."""
    return df.select(*[col(c) for c in df.columns if "Unnamed" not in c])


def leakage_suspects(names: list[str]) -> list[str]:
    """Column names that hint at a transformed target."""
    return [c for c in names if any(h in c.lower() for h in LEAK_HINTS)]


def inf_to_null_fill(df: DataFrame) -> DataFrame:
    """Infinities and numeric nulls become the median (0 without one), other nulls ''."""
    clean = select_with(df, {c: finite(col(c)) for c in fractional_columns(df)})
    rows, nulls = null_counts(clean)
    gaps = [c for c in numeric_columns(clean) if nulls[c]]
    middle = medians(clean, gaps, {c: rows - nulls[c] for c in gaps})
    changed = {c: F.coalesce(col(c).cast("double"), F.lit(float(m or 0.0))) for c, m in middle.items()}
    changed.update({c: F.coalesce(col(c), F.lit("")) for c in string_columns(clean)})
    return select_with(clean, changed)


def residual_fill(df: DataFrame) -> DataFrame:
    """Last resort, numbers 0 and texts `Unknown`; timestamps stay null."""
    changed: dict[str, Column] = {}
    for f in df.schema:
        if is_numeric(f.dataType):
            changed[f.name] = F.coalesce(col(f.name), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            changed[f.name] = F.coalesce(col(f.name), F.lit(UNKNOWN))
        elif isinstance(f.dataType, T.BooleanType):
            changed[f.name] = F.coalesce(col(f.name), F.lit(False))
    return select_with(df, changed)


def number(c: Column) -> Column:
    """Text or number to a finite double; null where it does not parse."""
    return finite(c.try_cast("double"))


def convert_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns to int, float, datetime or string; failures become null.

    `int` is kept as a double when a value has a fraction (lossless only).
    """
    from tabsmith.operators.dates import flexible_timestamp

    types = {c: t for c, t in types.items() if c in df.columns}
    whole = [c for c, t in types.items() if t == "int"]
    fits = {}
    if whole:
        tests = [F.coalesce(F.max((number(col(c)) % 1 != 0).cast("int")), F.lit(0)).alias(f"f{i}") for i, c in enumerate(whole)]
        row = df.agg(*tests).first()
        fits = {c: row[f"f{i}"] == 0 for i, c in enumerate(whole)}
    changed = {}
    for c, t in types.items():
        if t == "int":
            changed[c] = number(col(c)).cast("bigint") if fits[c] else number(col(c))
        elif t == "float":
            changed[c] = number(col(c)).cast("float")
        elif t == "datetime":
            changed[c] = flexible_timestamp(col(c)) if c in string_columns(df) else col(c).try_cast("timestamp")
        else:
            changed[c] = col(c).cast("string")
    return select_with(df, changed)


def numeric_if_mostly(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Text columns of which more than the threshold parse as numbers become numbers."""
    texts = string_columns(df)
    parsed = {c: number(F.regexp_replace(col(c), ",", "")) for c in texts}
    if not texts:
        return df
    row = df.agg(F.count("*").alias("rows"), *[F.count(parsed[c]).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    accepted = {c: parsed[c] for i, c in enumerate(texts) if row[f"n{i}"] > threshold * row["rows"]}
    return select_with(df, accepted)


def currency_to_number(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strip `, $ %` and parse."""
    return select_with(df, {c: number(F.regexp_replace(col(c), "[,$%]", "")) for c in columns})


def drop_null_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a null in any key column."""
    return df.na.drop(subset=[quote(c) for c in columns])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One copy of each row; copies merge before the shuffle."""
    return df.dropDuplicates()


def iqr_bounds(df: DataFrame, columns: list[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Frozen [Q1 - k IQR, Q3 + k IQR] per column with values."""
    found = {c: q for c, q in quartiles(df, columns).items() if q[0] is not None}
    return {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in found.items()}


def outside(c: Column, bounds: tuple[float, float]) -> Column:
    return F.coalesce((c < bounds[0]) | (c > bounds[1]), F.lit(False))


def flag_outliers_iqr(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Add `<column>_outlier`; nulls are no outliers."""
    bounds = iqr_bounds(df, columns, k)
    flags = {f"{c}_outlier": outside(col(c), bounds[c]) if c in bounds else F.lit(False) for c in columns}
    return select_with(df, flags)


def moments(df: DataFrame, columns: list[str], ddof: int = 1) -> dict[str, tuple]:
    """(mean, standard deviation) per column in one aggregate."""
    spread = F.stddev_samp if ddof else F.stddev_pop
    aggs = [F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]
    aggs += [spread(col(c)).alias(f"s{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def flag_outliers_zscore(df: DataFrame, columns: list[str], z: float = 3.0) -> DataFrame:
    """Add `<column>_outlier` where |x - mean| > z standard deviations."""
    flags = {}
    for c, (mean, std) in moments(df, columns).items():
        far = F.abs(col(c) - F.lit(mean)) > F.lit((std or 0.0) * z)
        flags[f"{c}_outlier"] = F.coalesce(far, F.lit(False)) if std else F.lit(False)
    return select_with(df, flags)


def clip_outliers(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip to frozen bounds; nulls stay null."""
    changed = {
        c: F.when(col(c).isNotNull(), F.greatest(F.least(col(c).cast("double"), F.lit(float(hi))), F.lit(float(lo))))
        for c, (lo, hi) in bounds.items()
        if c in df.columns
    }
    return select_with(df, changed)


def trim_outlier_rows(df: DataFrame, columns: list[str], fraction: float = 0.05) -> DataFrame:
    """Drop the given share of rows with the largest |z| over the features."""
    if not 0 < fraction <= 0.2:
        raise ValueError("fraction must lie in (0, 0.2]")
    scores = [
        F.coalesce(F.abs(col(c) - F.lit(m)) / F.lit(s), F.lit(0.0))
        for c, (m, s) in moments(df, columns).items()
        if s
    ]
    if not scores:
        return df
    distance = F.greatest(*scores, F.lit(0.0))
    cut = exact_quantiles(df.select(distance.alias("d")), ["d"], [1 - fraction])["d"][0]
    return df if cut is None else df.filter(distance <= F.lit(cut))
