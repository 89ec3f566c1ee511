"""Automatic cleaning, the flagship.

Three aggregate passes decide everything, then one projection does the work:
pass 1 nulls and date ratios, pass 2 fill values, pass 3 spread and skew of the
imputed frame. The driver holds parameters only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from tabsmith.functions.columns import col, numeric_columns
from tabsmith.functions.date_rules import DATE_PARTS
from tabsmith.functions.stats import null_count, skew_g1
from tabsmith.operators.clean import (
    TABLE_NULL_TOKENS,
    UNKNOWN,
    drop_duplicate_columns,
    drop_empty_rows,
)
from tabsmith.operators.dates import date_tests, date_verdict
from tabsmith.operators.frequency import modes
from tabsmith.operators.impute import fill_values
from tabsmith.operators.neighbours import impute_knn
from tabsmith.operators.quantiles import medians
from tabsmith.plans.params import finish, normalise, output_columns, schema_types, typed
from tabsmith.session import materialise

KNN_MINIMUM_ROWS = 11


@dataclass
class Cleaned:
    frame: DataFrame
    params: dict
    report: DataFrame


def auto_clean(
    df: DataFrame,
    *,
    tokens: list[str] = TABLE_NULL_TOKENS,
    sparse: float = 0.95,
    numeric: str = "knn",
    least: int = 2,
    most: int = 10,
    log_skew: float = 2.0,
    sqrt_skew: float = 1.0,
) -> Cleaned:
    """Clean a table and freeze what was learnt from it.

    `numeric` is "knn" (neighbours, as many as 5) or "median", which is also
    used where neighbours can not be compared. Serving always
    uses the frozen medians, since new rows have no training neighbours.
    """
    df = drop_duplicate_columns(df)
    clean = drop_empty_rows(normalise(df, tokens))

    rough = [f.name for f in clean.schema if isinstance(f.dataType, (T.StringType, T.BooleanType, T.NumericType))]
    first = clean.agg(
        F.count("*").alias("rows"),
        *[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(clean.columns)],
        *[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(rough)],
        *date_tests(clean),
    ).first()
    rows = first["rows"]
    nulls = {c: first[f"n{i}"] for i, c in enumerate(clean.columns)}
    seen = {c: first[f"d{i}"] for i, c in enumerate(rough)}
    too_sparse = [c for c in clean.columns if nulls[c] > sparse * rows]
    kept = [c for c in clean.columns if c not in too_sparse]
    dates = [c for c in date_verdict(clean, first) if c in kept]
    params = {
        "input": schema_types(df),
        "null_tokens": list(tokens),
        "sparse": too_sparse,
        "dates": dates,
        "clip": {},
        "drop_first": True,
    }
    ready = typed(clean, params)

    texts = [f.name for f in ready.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    made = {f"{c}_{p}" for c in dates for p in DATE_PARTS}
    numbers = [c for c in numeric_columns(ready) if c not in made]
    gaps = [c for c in numbers if nulls[c]]
    mode = {c: m if m is not None else UNKNOWN for c, m in modes(ready, [c for c in texts if nulls[c]]).items()}
    middle = {c: float(m or 0.0) for c, m in medians(ready, gaps, {c: rows - nulls[c] for c in gaps}).items()}
    params["fill"] = {**mode, **middle}
    use_knn = numeric == "knn" and bool(gaps) and rows >= KNN_MINIMUM_ROWS
    imputed = fill_values(ready, mode if use_knn else params["fill"])
    if use_knn:
        imputed = materialise(impute_knn(imputed, numbers, min(5, max(2, rows // 2))), "imputed")

    decide(imputed, params, numbers, texts, seen, least, most, log_skew, sqrt_skew)
    params["output"] = output_columns(kept, dates, DATE_PARTS, params)
    report = _report(df, params, rows, nulls, use_knn, mode, middle)
    return Cleaned(finish(imputed, params), params, report)


def decide(df, params, numbers, texts, seen, least, most, log_skew, sqrt_skew) -> None:
    """Pass 3: constants, skew features and categories of the imputed frame.

    `seen` are rough distinct counts of before the filling. Filled numbers can
    have many more values, so theirs are counted again; exact value lists are
    taken only of columns near the bounds.
    """
    near = [c for c in numbers + texts if seen.get(c, 0) <= 2 * most + 10]
    filled = [c for c in near if c in numbers]
    if filled:
        now = df.agg(*[F.approx_count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(filled)]).first()
        grown = {c for i, c in enumerate(filled) if now[f"c{i}"] > 2 * most + 10}
        near = [c for c in near if c not in grown]
    others = [c for c in df.columns if c not in numbers and c not in texts]
    aggs = [F.array_sort(F.collect_set(col(c).cast("string"))).alias(f"low{i}") for i, c in enumerate(near)]
    for i, c in enumerate(numbers):
        aggs += [skew_g1(col(c)).alias(f"g{i}"), F.min(col(c)).cast("double").alias(f"lo{i}")]
    for i, c in enumerate(others):
        aggs.append(F.coalesce(F.min(col(c)) == F.max(col(c)), F.lit(True)).alias(f"flat{i}"))
    row = df.agg(*aggs).first() if aggs else {}
    low = {c: list(row[f"low{i}"]) for i, c in enumerate(near) if len(row[f"low{i}"]) <= most}
    params["constant"] = [c for c in df.columns if c in low and len(low[c]) <= 1]
    params["constant"] += [c for i, c in enumerate(others) if row[f"flat{i}"]]
    params["transforms"] = {}
    for i, c in enumerate(numbers):
        skew, lowest = row[f"g{i}"], row[f"lo{i}"]
        if skew is None or lowest is None or len(low.get(c, "many")) <= 2:
            continue
        kinds = ["log"] if skew > log_skew and lowest > 0 else []
        kinds += ["sqrt"] if skew > sqrt_skew and lowest >= 0 else []
        if kinds:
            params["transforms"][c] = kinds
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    params["one_hot"] = {c: low[c] for c in texts if c in strings and c in low and least <= len(low[c]) <= most}


def _report(df, params, rows, nulls, used_knn, mode, middle) -> DataFrame:
    """(section, column, detail, value) rows of what was done."""
    lines = [("shape", None, "rows", float(rows)), ("shape", None, "columns", float(len(params["output"])))]
    for c, n in nulls.items():
        if n:
            if c in params["sparse"] or c in params["dates"]:
                how = "none"
            elif c in mode:
                how = f"mode={mode[c]}"
            elif c in middle:
                how = "knn" if used_knn else "median"
            else:
                how = "none"
            lines.append(("missing", c, how, float(n)))
    lines += [("dropped", c, "sparse", None) for c in params["sparse"]]
    lines += [("dropped", c, "single value", None) for c in params["constant"]]
    lines += [("dates", c, "parsed", None) for c in params["dates"]]
    lines += [("engineered", c, k, None) for c, kinds in params["transforms"].items() for k in kinds]
    lines += [("engineered", c, "one_hot", float(len(v))) for c, v in params["one_hot"].items()]
    return df.sparkSession.createDataFrame(lines, "section string, column string, detail string, value double")
