"""Automatic feature engineering."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabsmith.functions.columns import date_columns, numeric_columns, string_columns
from tabsmith.functions.date_rules import DATE_PARTS
from tabsmith.operators.dates import date_features
from tabsmith.operators.features import (
    apply_decisions,
    apply_one_hot,
    auto_bin,
    mostly_dates,
    transform_decisions,
)
from tabsmith.operators.frequency import categories


def auto_features(df: DataFrame, auto_squared: bool = False) -> tuple[DataFrame, dict]:
    """Date parts, one-hot flags, numeric transforms and quartile codes.

    Rules read the original columns; engineered names are tracked, so a user
    column that happens to end in `_year` is treated like any other.
    """
    numbers = numeric_columns(df)
    dates = mostly_dates(df) + date_columns(df)
    dates = [c for c in df.columns if c in dates]
    texts = [c for c in string_columns(df) if c not in dates]
    report: dict = {"dates": dates}
    out = date_features(df, dates) if dates else df
    lists = {c: v for c, v in categories(df, texts, 9).items() if len(v) > 1}
    report["one_hot"] = {c: lists[c] for c in texts if c in lists}
    out = apply_one_hot(out, report["one_hot"], drop_first=True)
    report["transforms"] = transform_decisions(df, numbers, auto_squared)
    out = apply_decisions(out, report["transforms"])
    before = set(out.columns)
    out = auto_bin(out, numbers)
    report["binned"] = [c for c in out.columns if c not in before]
    report["date_features"] = [f"{c}_{p}" for c in dates for p in DATE_PARTS]
    return out, report
