"""Model scores and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsmith.functions.columns import col
from tabsmith.operators.frequency import modes
from tabsmith.operators.ordered import running_total

# Metrics for which less is better.
LESS_IS_BETTER = {"MAE", "MSE", "RMSE", "RMSLE", "MAPE", "smape", "mape", "mae", "rmse", "TT"}
AUTO_METRIC = {"classification": "Accuracy", "regression": "R2"}


def classification_metrics(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """M8: Accuracy, Recall, Precision, F1 (class-weighted), Kappa and MCC.

    The rows are reduced to (label, prediction) counts first; every count then
    adds to its true class and to its guessed class, so nothing is joined.
    """
    by = list(by)
    text = lambda c: col(c).cast("string")
    counts = df.groupBy(*by, text(label).alias("y"), text(prediction).alias("p")).agg(F.count("*").cast("double").alias("n"))
    zero = F.lit(0.0)
    sides = F.array(
        F.struct(
            F.col("y").alias("k"), F.col("n").alias("support"),
            F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("hit"), zero.alias("guessed"),
        ),
        F.struct(F.col("p").alias("k"), zero.alias("support"), zero.alias("hit"), F.col("n").alias("guessed")),
    )
    per = counts.select(*by, F.explode(sides).alias("c")).groupBy(*by, "c.k").agg(
        F.sum("c.support").alias("support"), F.sum("c.hit").alias("hit"), F.sum("c.guessed").alias("guessed")
    )
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0))
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("guessed")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    weight = F.col("support")
    one = per.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.sum("hit").alias("c"),
        F.sum(weight * recall).alias("r"),
        F.sum(weight * precision).alias("p"),
        F.sum(weight * f1).alias("f"),
        F.sum(F.col("support") * F.col("guessed")).alias("sg"),
        F.sum(F.col("support") * F.col("support")).alias("ss"),
        F.sum(F.col("guessed") * F.col("guessed")).alias("gg"),
    )
    n, c, sg = F.col("n"), F.col("c"), F.col("sg")
    chance = sg / (n * n)
    spread = F.sqrt((n * n - F.col("ss")) * (n * n - F.col("gg")))
    return one.select(
        *by,
        (c / n).alias("Accuracy"),
        (F.col("r") / n).alias("Recall"),
        (F.col("p") / n).alias("Prec"),
        (F.col("f") / n).alias("F1"),
        F.coalesce(F.try_divide(c / n - chance, 1 - chance), F.lit(0.0)).alias("Kappa"),
        F.coalesce(F.try_divide(c * n - sg, spread), F.lit(0.0)).alias("MCC"),
    )


def auc(df: DataFrame, positive: Column, score: str, by: list[str] = (), chunk_rows: int | None = None) -> DataFrame:
    """M8: area under the ROC curve by ranks, ties counted half.

    Equal scores are merged before they are put in order, and the running
    count works in chunks, so neither a common score nor many scores end up in
    one task.
    """
    by = list(by)
    per = df.filter(col(score).isNotNull()).groupBy(*by, col(score).cast("double").alias("s")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("pos"), F.sum(F.when(positive, 0).otherwise(1)).alias("neg")
    )
    placed = running_total(per, by, "s", "neg", "upto", chunk_rows)
    below = F.col("upto") - F.col("neg")
    area = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2.0))
    one = placed.groupBy(*by).agg(area.alias("a"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    return one.select(*by, F.try_divide(F.col("a"), F.col("p") * F.col("n")).alias("AUC"))


def regression_metrics(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """M9: MAE, MSE, RMSE, R2, RMSLE and MAPE in one aggregate."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    error = y - p
    logs = F.log1p(F.abs(p)) - F.log1p(F.abs(y))
    base = df.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("MAE"),
        F.avg(error * error).alias("MSE"),
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        F.var_pop(F.when(p.isNotNull(), y)).alias("_v"),
        F.sqrt(F.avg(logs * logs)).alias("RMSLE"),
        F.avg(F.abs(error / F.nullif(y, F.lit(0.0)))).alias("MAPE"),
    )
    r2 = 1 - F.try_divide(F.col("MSE"), F.col("_v"))
    return base.select(*by, "MAE", "MSE", "RMSE", r2.alias("R2"), "RMSLE", "MAPE")


def leaderboard(results: DataFrame, metric: str) -> DataFrame:
    """All models ranked in the direction of the metric, failed ones last."""
    value = F.col(metric)
    best = value.asc_nulls_last() if metric in LESS_IS_BETTER else value.desc_nulls_last()
    order = W.orderBy(best, "Model")  # one row per model
    return results.select(F.row_number().over(order).alias("rank"), "*")


def dummy_baseline(df: DataFrame, target: str, task: str) -> DataFrame:
    """Predict the majority class or the mean for every row."""
    if task == "classification":
        return df.withColumn("prediction", F.lit(modes(df, [target])[target]))
    return df.withColumn("prediction", F.lit(df.agg(F.avg(col(target)).alias("m")).first()["m"]))
