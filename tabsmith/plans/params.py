"""Frozen parameters: one builder for training and serving.

Parameters are plain JSON data. `apply_params` turns them into projections
only, so it needs no action and works on batches and streams alike.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, types as T

from tabsmith.functions.columns import col, finite, fractional_columns, select_with
from tabsmith.operators.clean import (
    align_columns,
    blank_to_null,
    clip_outliers,
    null_tokens,
    residual_fill,
)
from tabsmith.operators.dates import date_features
from tabsmith.operators.features import TRANSFORMS, apply_one_hot, one_hot_columns
from tabsmith.operators.impute import fill_values


def save_params(spark: SparkSession, params: dict, path: str) -> None:
    """Write parameters as one JSON document."""
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def normalise(df: DataFrame, tokens: list[str]) -> DataFrame:
    """Missing texts, blanks, NaN and infinities become null."""
    clean = blank_to_null(null_tokens(df, tokens))
    return select_with(clean, {c: finite(col(c)) for c in fractional_columns(clean)})


def prepare(df: DataFrame, params: dict) -> DataFrame:
    """Align, normalise, drop, parse dates and add their parts."""
    return typed(normalise(align_columns(df, params["input"]), params["null_tokens"]), params)


def typed(clean: DataFrame, params: dict) -> DataFrame:
    """Drop sparse columns and parse dates of a normalised frame."""
    kept = clean.select(*[col(c) for c in clean.columns if c not in params["sparse"]])
    return date_features(kept, params["dates"]) if params["dates"] else kept


def finish(df: DataFrame, params: dict) -> DataFrame:
    """Clip, derive, drop, fill the rest and put the columns in order."""
    clipped = clip_outliers(df, {c: tuple(b) for c, b in params["clip"].items()})
    derived = {f"{c}_{k}": TRANSFORMS[k](col(c)) for c, kinds in params["transforms"].items() for k in kinds}
    out = apply_one_hot(select_with(clipped, derived), params["one_hot"], params["drop_first"])
    return residual_fill(out.select(*[col(c) for c in params["output"]]))


def apply_params(df: DataFrame, *chain: dict) -> DataFrame:
    """Serve new rows with frozen values; several parameter sets in turn."""
    for params in chain:
        df = finish(fill_values(prepare(df, params), params["fill"]), params)
    return df


def output_columns(columns: list[str], dates: list[str], parts: list[str], params: dict) -> list[str]:
    """Originals, date features, numeric features, one-hot flags."""
    dropped = set(params["constant"])
    derived = [f"{c}_{k}" for c, kinds in params["transforms"].items() for k in kinds]
    flags = list(one_hot_columns(params["one_hot"], params["drop_first"]))
    date_parts = [f"{c}_{p}" for c in dates for p in parts]
    return [c for c in columns + date_parts if c not in dropped] + derived + flags


def schema_types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema if not isinstance(f.dataType, T.NullType)}
