"""Feature engineering: transforms, bins, encodings, scaling."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tabsmith.functions.columns import col, finite, numeric_columns, select_with, string_columns
from tabsmith.functions.stats import skew_g1
from tabsmith.operators.clean import convert_types, drop_columns, moments
from tabsmith.operators.dates import date_features, flexible_timestamp
from tabsmith.operators.frequency import categories
from tabsmith.operators.gram import moments as product_moments
from tabsmith.operators.ordered import POS, over_preceding, with_position
from tabsmith.operators.quantiles import exact_quantiles

# --- numeric transforms -------------------------------------------------------

def log_of(c: Column) -> Column:
    return F.log1p(F.when(c.isNotNull(), F.greatest(c.cast("double"), F.lit(0.0))))


def sqrt_of(c: Column) -> Column:
    return F.sqrt(F.when(c.isNotNull(), F.greatest(c.cast("double"), F.lit(0.0))))


def squared_of(c: Column) -> Column:
    return c.cast("double") * c.cast("double")


def reciprocal_of(c: Column) -> Column:
    value = finite(c.cast("double"))
    return F.when(value != 0, 1.0 / value)


TRANSFORMS = {"log": log_of, "sqrt": sqrt_of, "squared": squared_of, "reciprocal": reciprocal_of}


def transform(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Add `<column>_<kind>` for log, sqrt, squared or reciprocal."""
    return select_with(df, {f"{c}_{kind}": TRANSFORMS[kind](col(c)) for c in columns if c in df.columns})


def skew_decisions(df: DataFrame, columns: list[str], binary: set[str] | None = None) -> dict[str, list[str]]:
    """E1 rules: log when G1 > 2 and all > 0, sqrt when G1 > 1 and all >= 0."""
    if not columns:
        return {}
    aggs = [skew_g1(col(c)).alias(f"g{i}") for i, c in enumerate(columns)]
    aggs += [F.min(col(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs).first()
    if binary is None:
        binary = set(categories(df, columns, 2))
    chosen = {}
    for i, c in enumerate(columns):
        g, lo = row[f"g{i}"], row[f"lo{i}"]
        if c in binary or g is None or lo is None:
            continue
        kinds = (["log"] if g > 2 and lo > 0 else []) + (["sqrt"] if g > 1 and lo >= 0 else [])
        if kinds:
            chosen[c] = kinds
    return chosen


def apply_decisions(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    return select_with(df, {f"{c}_{k}": TRANSFORMS[k](col(c)) for c, kinds in chosen.items() for k in kinds})


def auto_skew_features(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Add log and sqrt features for skewed columns."""
    columns = [c for c in numeric_columns(df) if c not in exclude]
    return apply_decisions(df, skew_decisions(df, columns))


def transform_decisions(df: DataFrame, columns: list[str], auto_squared: bool = False) -> dict[str, list[str]]:
    """E2 rules, from one aggregate."""
    if not columns:
        return {}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        positive = F.when(col(c) > 0, col(c))
        aggs += [F.count(positive).alias(f"p{i}"), skew_g1(positive).alias(f"g{i}"), skew_g1(col(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    chosen = {}
    for i, c in enumerate(columns):
        if row[f"p{i}"] < 0.5 * row["rows"] or row[f"p{i}"] == 0:
            continue
        kinds = ["log"] if abs(row[f"g{i}"] or 0.0) > 1 else []
        kinds.append("sqrt")
        if auto_squared and (row[f"s{i}"] or 0.0) < -0.5:
            kinds.append("squared")
        chosen[c] = [*kinds, "reciprocal"]
    return chosen


def auto_transform(df: DataFrame, exclude: list[str] = (), auto_squared: bool = False) -> DataFrame:
    """Log, sqrt and reciprocal of mostly positive columns."""
    columns = [c for c in numeric_columns(df) if c not in exclude]
    return apply_decisions(df, transform_decisions(df, columns, auto_squared))


# --- bins ----------------------------------------------------------------------

def quantile_edges(df: DataFrame, columns: list[str], q: int) -> dict[str, list[float]]:
    """Distinct quantile edges per column; fewer than two means no bins."""
    found = exact_quantiles(df, columns, [i / q for i in range(q + 1)])
    return {c: sorted({e for e in edges if e is not None}) for c, edges in found.items()}


def bin_code(c: Column, edges: list[float]) -> Column:
    """Zero-based code of the right-closed bin; the lowest value is in bin 0."""
    code = sum((F.when(c > F.lit(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when(c.isNotNull() & (c >= F.lit(edges[0])) & (c <= F.lit(edges[-1])), code)


def interval_labels(edges: list[float], precision: int = 3) -> list[str]:
    """Texts such as `(-0.001, 1.0]`; the first lower edge is moved down."""
    digits = precision
    while digits < 20:
        rounded = [_short(e, digits) for e in edges]
        if len(set(rounded)) == len(edges):
            break
        digits += 1
    rounded[0] = _short(rounded[0] - 10.0 ** -digits, digits)
    return [f"({a}, {b}]" for a, b in zip(rounded, rounded[1:])]


def _short(x: float, precision: int) -> float:
    if x == 0 or not math.isfinite(x):
        return float(x)
    whole = math.trunc(x)
    digits = precision if whole else -int(math.floor(math.log10(abs(x)))) - 1 + precision
    return float(round(x, digits))


def quantile_bin(
    df: DataFrame, column: str, q: int = 4, labels: list[str] | str | None = None
) -> DataFrame:
    """Add `<column>_binned`: interval text, custom labels, or codes.

    `labels="codes"` gives integer codes. When repeated edges leave another
    number of bins than labels, the column is left out.
    """
    edges = quantile_edges(df, [column], q)[column]
    if len(edges) < 2:
        return df
    code = bin_code(col(column), edges)
    if labels == "codes":
        return select_with(df, {f"{column}_binned": code.cast("int")})
    names = interval_labels(edges) if labels is None else list(labels)
    if len(names) != len(edges) - 1:
        return df
    return select_with(df, {f"{column}_binned": F.get(F.array(*map(F.lit, names)), code.cast("int"))})


def auto_bin(df: DataFrame, columns: list[str], q: int = 4, fewest: int = 10) -> DataFrame:
    """E4 in auto mode: integer codes for columns with at least ten values."""
    few = set(categories(df, columns, fewest - 1))
    edges = quantile_edges(df, [c for c in columns if c not in few], q)
    codes = {f"{c}_binned": bin_code(col(c), e).cast("int") for c, e in edges.items() if len(e) > 1}
    return select_with(df, codes)


# --- encodings -----------------------------------------------------------------

def one_hot_columns(lists: dict[str, list[str]], drop_first: bool) -> dict[str, tuple[str, str]]:
    """{new name: (column, value)} for frozen category lists."""
    return {f"{c}_{v}": (c, v) for c, values in lists.items() for v in values[1 if drop_first else 0 :]}


def apply_one_hot(df: DataFrame, lists: dict[str, list[str]], drop_first: bool) -> DataFrame:
    flags = {
        name: F.coalesce(col(c).cast("string") == v, F.lit(False))
        for name, (c, v) in one_hot_columns(lists, drop_first).items()
        if c in df.columns
    }
    return select_with(df, flags)


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = False, least: int = 1, most: int | None = None) -> DataFrame:
    """E5: a boolean per sorted category; null is false everywhere.

    Every value becomes a column, so the caller answers for their number; `most`
    leaves columns with more values out.
    """
    lists = {c: v for c, v in categories(df, columns, most).items() if len(v) >= least}
    return apply_one_hot(df, {c: lists[c] for c in columns if c in lists}, drop_first)


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null becomes "missing"; codes follow the sorted texts.

    Codes are positions in the distinct values, so no task holds the column
    and the driver sees none of the labels.
    """
    out = df
    for i, c in enumerate(columns):
        text = F.coalesce(col(c).cast("string"), F.lit("missing"))
        values = df.select(text.alias("_v")).distinct()
        codes = with_position(values, [], "_v").select(F.col("_v").alias(f"_v{i}"), F.col(POS).cast("int").alias(f"_c{i}"))
        out = out.join(codes, text == F.col(f"_v{i}"), "left")
    return out.select(*[F.col(f"_c{columns.index(c)}").alias(c) if c in columns else col(c) for c in df.columns])


def target_means(df: DataFrame, column: str, target: str, smoothing: float = 0.0) -> DataFrame:
    """Mean target per category, drawn to the overall mean by `smoothing` rows."""
    overall = df.agg(F.avg(col(target)).alias("m")).first()["m"] or 0.0
    grouped = df.filter(col(column).isNotNull()).groupBy(col(column).alias("_k")).agg(
        F.sum(col(target)).alias("s"), F.count(col(target)).alias("n")
    )
    mean = (F.col("s") + F.lit(smoothing * overall)) / (F.col("n") + F.lit(smoothing))
    return grouped.select("_k", F.when(F.col("n") > 0, mean).otherwise(F.lit(overall)).alias("_m"))


def target_encode(df: DataFrame, columns: list[str], target: str, smoothing: float = 0.0) -> DataFrame:
    """Add `<column>_target`; an unseen or null category gets the overall mean."""
    overall = df.agg(F.avg(col(target)).alias("m")).first()["m"] or 0.0
    out = df
    for i, c in enumerate(columns):
        means = target_means(df, c, target, smoothing).toDF(f"_k{i}", f"_m{i}")
        out = out.join(means, col(c) == F.col(f"_k{i}"), "left")
    return out.select(
        *[col(c) for c in df.columns],
        *[F.coalesce(F.col(f"_m{i}"), F.lit(overall)).alias(f"{c}_target") for i, c in enumerate(columns)],
    )


# --- scaling and projections ---------------------------------------------------

def scale(df: DataFrame, columns: list[str], how: str = "standard", ddof: int = 0) -> DataFrame:
    """Standard, minmax or robust scaling in place; no spread gives 0."""
    if how == "standard":
        found = moments(df, columns, ddof)
    elif how == "minmax":
        row = df.agg(
            *[F.min(col(c)).alias(f"a{i}") for i, c in enumerate(columns)],
            *[F.max(col(c)).alias(f"b{i}") for i, c in enumerate(columns)],
        ).first()
        found = {
            c: (row[f"a{i}"], None if row[f"a{i}"] is None else row[f"b{i}"] - row[f"a{i}"]) for i, c in enumerate(columns)
        }
    elif how == "robust":
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        found = {c: (v[1], None if v[0] is None else v[2] - v[0]) for c, v in q.items()}
    else:
        raise ValueError(f"unknown scaling {how!r}")
    changed = {}
    for c, (centre, spread) in found.items():
        if centre is not None:
            shifted = col(c).cast("double") - F.lit(float(centre))
            changed[c] = shifted / F.lit(float(spread)) if spread else shifted
    return select_with(df, changed)


def yeo_johnson(c: Column, lam: float) -> Column:
    x = c.cast("double")
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


#: Step and reach of the grids that close in on an exponent.
POWER_STEPS = ((0.25, 8), (0.025, 10), (0.0025, 10), (0.00025, 10))


def power_lambdas(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The exponent with the highest normal likelihood, to 0.00025.

    The likelihood has one peak, so a grid brackets it and each finer one has
    the bracket of the one before; each is one aggregate over all columns.
    """
    best = dict.fromkeys(columns, 0.0)
    for step, reach in POWER_STEPS:
        grid = {c: [best[c] + step * j for j in range(-reach, reach + 1)] for c in columns}
        aggs = []
        for i, c in enumerate(columns):
            x = col(c).cast("double")
            aggs.append(F.count(x).alias(f"n{i}"))
            aggs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"t{i}"))
            aggs += [F.var_pop(yeo_johnson(col(c), lam)).alias(f"v{i}_{j}") for j, lam in enumerate(grid[c])]
        row = df.agg(*aggs).first()
        for i, c in enumerate(columns):
            scores = [
                (-0.5 * row[f"n{i}"] * math.log(v) + (lam - 1) * row[f"t{i}"], -j, lam)
                for j, lam in enumerate(grid[c])
                for v in [row[f"v{i}_{j}"]]
                if v and v > 0
            ]
            best[c] = round(max(scores)[2], 6) if scores else 1.0
    return best


def power_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Make columns more normal (Yeo-Johnson), in place."""
    lambdas = power_lambdas(df, columns)
    return select_with(df, {c: yeo_johnson(col(c), lam) for c, lam in lambdas.items()})


def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """All monomials of degree 2 to `degree`, named `a^2`, `a b`."""
    added = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
            name = " ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())
            value = None
            for c in combo:
                value = col(c).cast("double") if value is None else value * col(c).cast("double")
            added[name] = value
    return select_with(df, added)


def principal_axes(df: DataFrame, columns: list[str], k: int) -> tuple[list[float], list[list[float]]]:
    """(means, axes): the k directions of largest spread of the complete rows, the largest first.

    One pass gives the products of all pairs of columns; the rest is a matrix
    as wide as the columns. The weight of an axis that is farthest from zero,
    the first of several, is positive, so a rerun gives the same signs.
    """
    numbers = [col(c).cast("double") for c in columns]
    rough = df.agg(*[F.avg(finite(x)).alias(f"m{i}") for i, x in enumerate(numbers)]).first()
    found = product_moments(df.select(F.array(*numbers).alias("x")), "x", [m or 0.0 for m in rough])
    spread, axes = np.linalg.eigh(found.cross)
    out = []
    for axis in axes.T[np.argsort(-spread, kind="stable")][:k]:
        top = axis[np.argmax(np.abs(axis) > np.abs(axis).max() * (1 - 1e-9))]
        out.append([float(w) for w in (axis if top > 0 else -axis)])
    return [float(m) for m in found.mean], out


def pca(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Add `pc1..pck`, projections of the centred columns.

    Rows with nulls get null components and have no part in the axes.
    """
    if not 1 <= k <= len(columns):
        raise ValueError("there are as many components as columns at most")
    means, axes = principal_axes(df, columns, k)
    centred = [col(c).cast("double") - F.lit(m) for c, m in zip(columns, means)]
    parts = {f"pc{i + 1}": sum((x * F.lit(w) for x, w in zip(centred[1:], axis[1:])), centred[0] * F.lit(axis[0])) for i, axis in enumerate(axes)}
    return df.select("*", *[v.alias(n) for n, v in parts.items()])


def lag_features(df: DataFrame, columns: dict[str, list[int]], order: str, by=(), chunk_rows=None) -> DataFrame:
    """Add `<column>_lag<k>` in series order."""
    reach = max(k for lags in columns.values() for k in lags)
    build = lambda w: {f"{c}_lag{k}": F.lag(col(c), k).over(w) for c, lags in columns.items() for k in lags}
    return over_preceding(df, list(by), order, reach, build, chunk_rows).drop(POS)


# --- configured and automatic flows ---------------------------------------------

# The keys of a configuration, with the transform each asks for.
CONFIG_TRANSFORMS = [
    ("log_transform", "log"),
    ("sqrt_transform", "sqrt"),
    ("squared_transform", "squared"),
    ("reciprocal_transform", "reciprocal"),
]


def apply_transformations(df: DataFrame, config: dict) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Configured steps in a fixed order; a step that does not fit is skipped.

    All numeric transforms read the original columns and form one projection;
    only bins and categories need an aggregate. The steps done come along as
    (kind, column, setting).
    """
    steps: list[tuple[str, str, str]] = []
    added: dict[str, Column] = {}
    numbers = set(numeric_columns(df))
    for key, kind in CONFIG_TRANSFORMS:
        for c in config.get(key, []):
            if c in numbers:
                added[f"{c}_{kind}"] = TRANSFORMS[kind](col(c))
                steps.append((kind, c, ""))
    out = select_with(df, added)
    for item in config.get("binning", []):
        c = item["column"]
        if c in numbers:
            binned = quantile_bin(out, c, item["bins"], item.get("labels"))
            if binned is not out:
                steps.append(("bins", c, str(item["bins"])))
            out = binned
    hot = [c for c in config.get("one_hot_encoding", []) if c in df.columns]
    if hot:
        lists = categories(df, hot, config.get("max_categories"))
        out = apply_one_hot(out, {c: lists[c] for c in hot if c in lists}, config.get("drop_first", False))
        steps += [("one_hot", c, str(len(lists[c]))) for c in hot if c in lists]
    for item in config.get("datetime_features", []):
        if item["column"] in df.columns:
            out = date_features(out, [item["column"]], item["features"])
            steps.append(("date_parts", item["column"], ",".join(item["features"])))
    dropped = [c for c in config.get("columns_to_drop", []) if c in out.columns]
    if dropped:
        out = drop_columns(out, dropped)
        steps += [("drop", c, "") for c in dropped]
    types = {c: t for c, t in config.get("data_types", {}).items() if c in out.columns}
    if types:
        out = convert_types(out, types)
        steps += [("type", c, t) for c, t in types.items()]
    return out, steps


def mostly_dates(df: DataFrame) -> list[str]:
    """Text columns of which more than half of the rows parse as dates."""
    texts = string_columns(df)
    if not texts:
        return []
    tests = [F.count(flexible_timestamp(col(c))).alias(f"t{i}") for i, c in enumerate(texts)]
    row = df.agg(F.count("*").alias("rows"), *tests).first()
    return [c for i, c in enumerate(texts) if row[f"t{i}"] > 0.5 * row["rows"]]
