"""Feature relevance and choice."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsmith.functions.columns import col, is_numeric, numeric_columns, select_with
from tabsmith.functions.stats import null_count
from tabsmith.operators.features import bin_code, quantile_edges
from tabsmith.operators.frequency import categories, distinct_counts

MISSING = "missing"


def _levels(df: DataFrame, columns: list[str], bins: int) -> dict[str, Column]:
    """Each column as a discrete text: numbers with many values by quantile bin."""
    numbers = [c for c in columns if c in numeric_columns(df)]
    few = set(categories(df, numbers, bins))
    edges = quantile_edges(df, [c for c in numbers if c not in few], bins)
    levels = {}
    for c in columns:
        e = edges.get(c)
        value = bin_code(col(c), e).cast("string") if e and len(e) > 1 else col(c).cast("string")
        levels[c] = F.coalesce(value, F.lit(MISSING))
    return levels


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """M1: (feature, importance) in nats, highest first.

    Numbers with more than `bins` values are cut at their quantiles (a plug-in
    estimate; no neighbour search). One unpivot and one grouped count give all
    contingency tables; everything after works on those counts.
    """
    levels = _levels(df, features + [target], bins)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), levels[f].alias("x")) for f in features])
    pairs = df.select(levels[target].alias("y"), F.explode(cells).alias("c")).select("c.feature", "c.x", "y")
    joint = pairs.groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    by_x = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    by_y = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    full = joint.join(by_x, ["feature", "x"]).join(by_y, ["feature", "y"]).join(F.broadcast(total), "feature")  # a row per feature
    share = F.col("n") / F.col("nt")
    score = F.sum(share * F.log(F.col("n") * F.col("nt") / (F.col("nx").cast("double") * F.col("ny"))))
    return full.groupBy("feature").agg(F.greatest(score, F.lit(0.0)).alias("importance"))


def correlation_importance(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """M2: absolute correlation with a numeric target; 0 where undefined."""
    means = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    filled = select_with(df, {c: F.coalesce(col(c).cast("double"), F.lit(means[f"m{i}"])) for i, c in enumerate(features)})
    one = filled.agg(*[F.corr(col(c), col(target).cast("double")).alias(f"r{i}") for i, c in enumerate(features)])
    value = lambda i: F.when(F.isnan(f"r{i}"), 0.0).otherwise(F.coalesce(F.abs(f"r{i}"), F.lit(0.0)))
    cells = [F.struct(F.lit(c).alias("feature"), value(i).alias("importance")) for i, c in enumerate(features)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def rank_features(df: DataFrame, importance: DataFrame) -> DataFrame:
    """M3: rank, shares, running share, type, nulls and distinct values.

    The windows run over one row per feature.
    """
    features = [r["feature"] for r in importance.select("feature").collect()]
    row = df.agg(*[null_count(col(c)).alias(f"n{i}") for i, c in enumerate(features)])
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit("numeric" if is_numeric(df.schema[c].dataType) else "categorical").alias("feature_type"),
            F.col(f"n{i}").alias("missing"),
        )
        for i, c in enumerate(features)
    ]
    facts = row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    seen = distinct_counts(df, features).select(F.col("column").alias("feature"), "distinct")
    joined = importance.join(F.broadcast(facts), "feature").join(F.broadcast(seen), "feature")  # a row per feature
    order = W.orderBy(F.desc("importance"), "feature")
    total = F.sum("importance").over(W.partitionBy())
    running = F.sum("importance").over(order.rowsBetween(W.unboundedPreceding, 0))
    return joined.select(
        F.row_number().over(order).alias("rank"),
        "feature",
        "importance",
        F.coalesce(F.try_divide(F.col("importance"), total) * 100, F.lit(0.0)).alias("relative_percent"),
        F.coalesce(F.try_divide(running, total) * 100, F.lit(0.0)).alias("cumulative_percent"),
        "feature_type",
        "missing",
        "distinct",
    )


def recommend_features(ranked: DataFrame, share: float = 0.8, most: int = 10, least: int = 3) -> DataFrame:
    """M4: features in order while less than `share` is covered, at most
    `most`, and at least `least`."""
    before = (F.col("cumulative_percent") - F.col("relative_percent")) / 100
    wanted = (before < share) & (F.col("rank") <= most)
    return ranked.filter(wanted | (F.col("rank") <= least))


def features_within(ranked: DataFrame, share: float = 0.60) -> DataFrame:
    """M4, strict form: features whose running share stays within the limit."""
    return ranked.filter(F.col("cumulative_percent") / 100 <= share)


def validate_target(df: DataFrame, target: str, task: str) -> DataFrame:
    """M5: (level, message, classes) for a target."""
    numeric = is_numeric(df.schema[target].dataType)
    classes = distinct_counts(df, [target]).select(F.col("distinct").alias("classes"))
    n = F.col("classes")
    if task == "regression":
        level = F.lit("ok" if numeric else "error")
        message = F.lit("numeric target" if numeric else "regression needs a numeric target")
    else:
        level = F.when(n < 2, "error").when(n > 20, "warning").otherwise("ok")
        message = (
            F.when(n < 2, "fewer than two classes")
            .when(n > 50, "more than 50 classes, this looks like regression")
            .when(n > 20, "more than 20 classes")
            .otherwise("class target")
        )
    return classes.select(level.alias("level"), message.alias("message"), "classes")


def select_by_score(df: DataFrame, features: list[str], target: str, k: int) -> list[str]:
    """The k features with the most information about the target."""
    top = mutual_information(df, features, target).orderBy(F.desc("importance"), "feature").limit(k)
    return [r["feature"] for r in top.collect()]
