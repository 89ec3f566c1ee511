"""Splits, metrics, leaderboards and saved models."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import scores, selection
from tabsmith.operators.information import neighbour_information
from tabsmith.plans import training


@pytest.fixture(scope="module")
def flowers(spark):
    rng = np.random.default_rng(0)
    n = 240
    kind = rng.integers(0, 2, n)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "length": rng.normal(size=n) + 2.5 * kind,
            "width": rng.normal(size=n),
            "colour": np.where(rng.random(n) < 0.8, np.where(kind == 1, "red", "blue"), "green"),
            "kind": np.where(kind == 1, "rose", "iris"),
            "price": 10 + 5.0 * kind + rng.normal(size=n) * 0.1,
        }
    )
    df = spark.createDataFrame(pdf)
    return df.withColumn("width", F.when(F.col("id") % 9 != 0, F.col("width"))).cache()


def test_split(flowers):
    train, test = training.split(flowers, ["id"], 0.8, 123)
    assert train.count() + test.count() == 240 and 0.7 < train.count() / 240 < 0.9
    again, _ = training.split(flowers.repartition(5), ["id"], 0.8, 123)
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in train.collect())
    with pytest.raises(ValueError):
        training.split(flowers, ["id"], 0.95)


def test_class_metrics_by_hand(spark):
    y = list("aaaabbbbcc")
    p = list("aaabbbbaca")
    df = spark.createDataFrame(list(zip(y, p)), "y string, p string")
    got = scores.classification_metrics(df, "y", "p").first().asDict()
    n, hit = 10, sum(a == b for a, b in zip(y, p))
    chance = sum(y.count(k) * p.count(k) for k in "abc") / n**2
    assert math.isclose(got["Accuracy"], hit / n) and math.isclose(got["Recall"], hit / n)
    assert math.isclose(got["Kappa"], (hit / n - chance) / (1 - chance))
    precision = {k: sum(a == b == k for a, b in zip(y, p)) / p.count(k) for k in "abc"}
    assert math.isclose(got["Prec"], sum(y.count(k) * precision[k] for k in "abc") / n)


def test_single_class_metrics(spark):
    df = spark.createDataFrame([("a", "a")] * 3, "y string, p string")
    got = scores.classification_metrics(df, "y", "p").first()
    assert (got["Accuracy"], got["Kappa"], got["MCC"]) == (1.0, 0.0, 0.0)


def test_leaderboard_direction(spark):
    df = spark.createDataFrame([("a", 3.0, 0.1), ("b", 1.0, 0.9), ("c", None, None)], "Model string, MAE double, R2 double")
    assert [r["Model"] for r in scores.leaderboard(df, "MAE").orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r["Model"] for r in scores.leaderboard(df, "R2").orderBy("rank").collect()] == ["b", "a", "c"]


def test_classification_flow(spark, flowers, tmp_path):
    done = training.train_leaderboard(
        flowers.drop("price"), "kind", "classification", ["id"], include=["Logistic Regression", "Decision Tree", "Linear SVM", "MLP"]
    )
    board = {r["Model"]: r for r in done.leaderboard.collect()}
    assert board[done.best]["rank"] == 1 and board["Dummy"]["rank"] == 5
    assert board["Logistic Regression"]["Accuracy"] > 0.85 and board["Linear SVM"]["AUC"] > 0.85
    training.save_model(done.model, str(tmp_path / "m"))
    rows = flowers.select("id", "length", "width", "colour").limit(50)
    types = {c: flowers.schema[c].dataType.simpleString() for c in done.features}
    scored = training.score(rows, training.load_model(str(tmp_path / "m")), types, done.labels)
    assert scored.join(flowers.select("id", "kind"), "id").filter("kind = prediction").count() >= 42
    with pytest.raises(ValueError):
        training.score(rows.drop("colour"), done.model, types, done.labels)
    odd = training.score(rows.withColumn("colour", F.lit("never seen")), done.model, types, done.labels)
    assert odd.filter("prediction is null").count() == 0


def test_many_classes_and_failures(spark, flowers):
    three = flowers.withColumn("kind", F.when(F.col("id") % 3 == 0, "tulip").otherwise(F.col("kind")))
    done = training.train_leaderboard(three, "kind", "classification", ["id"], ["length", "width"], include=["Decision Tree", "Gradient Boosting"])
    assert {r["Model"]: r["error"] for r in done.leaderboard.collect()} == {"Decision Tree": None, "Gradient Boosting": None, "Dummy": None}


def test_regression_flow(flowers):
    done = training.train_leaderboard(flowers.drop("kind"), "price", "regression", ["id"], metric="MAE", include=["Linear Regression", "Random Forest"])
    ranked = done.leaderboard.orderBy("rank").collect()
    assert [r["MAE"] for r in ranked] == sorted(r["MAE"] for r in ranked) and ranked[-1]["Model"] == "Dummy"


def test_bad_targets(flowers):
    with pytest.raises(ValueError):
        training.train_leaderboard(flowers, "kind", "regression", ["id"])
    with pytest.raises(ValueError):
        training.train_leaderboard(flowers.withColumn("one", F.lit("x")), "one", "classification", ["id"])


def test_tuning(flowers):
    ready, _, _ = training.assembled(flowers, ["length", "width"], "price", "regression")
    data = training.with_folds(ready, ["id"], 3, 1).select("features", "label", "fold").cache()
    model, settings, value = training.tune(data, "Ridge", training.regressors()["Ridge"], "regression", n_iter=3)
    assert set(settings) == {"regParam"} and value > 0.3


def test_information(flowers):
    ranked = selection.rank_features(flowers, selection.mutual_information(flowers, ["length", "width", "colour"], "kind"))
    rows = ranked.orderBy("rank").collect()
    assert {rows[0]["feature"], rows[1]["feature"]} == {"length", "colour"}
    assert math.isclose(rows[-1]["cumulative_percent"], 100.0)
    assert selection.select_by_score(flowers, ["length", "width", "colour"], "kind", 1) == [rows[0]["feature"]]
    assert selection.recommend_features(ranked).count() == 3


def test_information_of_a_copy(spark):
    df = spark.createDataFrame([(str(i % 4), str(i % 4), "x") for i in range(40)], "a string, b string, c string")
    got = {r["feature"]: r["importance"] for r in selection.mutual_information(df, ["a", "c"], "b").collect()}
    assert math.isclose(got["a"], math.log(4)) and got["c"] == 0.0


def plain_digamma(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def plain_information(x, y, k):
    rows = [i for i in range(len(x)) if y.count(y[i]) > 1]
    total = 0.0
    for i in rows:
        mine = sorted(abs(x[j] - x[i]) for j in rows if y[j] == y[i] and j != i)
        own = min(k, len(mine))
        r = mine[own - 1]
        m = sum(abs(x[j] - x[i]) < r * (1 - 1e-6) if r else x[j] == x[i] for j in rows)
        own = own if r else sum(x[j] == x[i] and y[j] == y[i] for j in rows)
        total += plain_digamma(own) - plain_digamma(len(mine) + 1) - plain_digamma(m)
    return max(0.0, plain_digamma(len(rows)) + total / len(rows))


@pytest.mark.parametrize("chunk_rows", [None, 50])
def test_information_by_neighbours_against_all_pairs(spark, chunk_rows):
    rng = np.random.default_rng(3)
    y = [str(v) for v in rng.integers(0, 4, 300)] + ["rare", "pair", "pair"]
    line = [float(float(v) * 3 + e) for v, e in zip([*y[:300], 0, 1, 1], rng.normal(size=303))]
    steps = [float(int(v) % 3) if v.isdigit() else 7.0 for v in y]
    noise = [float(v) for v in rng.integers(0, 40, 303)]
    words = ["abcdefg"[int(v) % 7] for v in noise]
    df = spark.createDataFrame(list(zip(y, line, steps, noise, words)), "y string, line double, steps double, `no ise` double, words string")
    got = {r["feature"]: r["importance"] for r in neighbour_information(df, ["line", "steps", "no ise", "words"], "y", chunk_rows=chunk_rows).collect()}
    for name, x in (("line", line), ("steps", steps), ("no ise", noise), ("words", ["abcdefg".index(w) for w in words])):
        assert math.isclose(got[name], plain_information(x, y, 3), abs_tol=1e-9), name
    assert got["line"] > 0.7 and got["steps"] > 0.7


def test_information_without_classes(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "y string, x double")
    assert [tuple(r) for r in neighbour_information(df, ["x"], "y").collect()] == [("x", 0.0)]
    assert [tuple(r) for r in neighbour_information(df.limit(0), ["x"], "y").collect()] == [("x", 0.0)]


def test_neighbours_vote_among_many_classes(spark):
    rows = [(float(i), f"k{i:04d}") for i in range(1200)]
    df = spark.createDataFrame(rows, "x double, kind string")
    got = training.neighbour_predict(df, df, ["x"], "kind", "classification", k=1)
    assert got.filter("label != prediction").count() == 0 and got.count() == 1200


def test_one_versus_rest_area(spark):
    rows = [(0.0, [0.7, 0.2, 0.1]), (1.0, [0.3, 0.4, 0.3]), (2.0, [0.1, 0.3, 0.6]), (0.0, [0.2, 0.5, 0.3]), (1.0, [0.1, 0.8, 0.1])]
    df = spark.createDataFrame(rows, "label double, scores array<double>").withColumn("Model", F.lit("m"))
    want, total = 0.0, 0
    for k in range(3):
        hit = [s[k] for y, s in rows if y == k]
        miss = [s[k] for y, s in rows if y != k]
        area = sum((a > b) + 0.5 * (a == b) for a in hit for b in miss) / (len(hit) * len(miss))
        want, total = want + area * len(hit), total + len(hit)
    assert math.isclose(training.class_auc(df, 3, ["Model"]).first()["AUC"], want / total)


def test_leaderboard_has_neighbours_and_a_holdout(flowers):
    done = training.train_leaderboard(
        flowers, "kind", "classification", ["id"], ["length", "width"], include=["Decision Tree", "K Neighbors"]
    )
    board = {r["Model"]: r for r in done.leaderboard.collect()}
    assert board["K Neighbors"]["Accuracy"] > 0.8 and board["K Neighbors"]["AUC"] > 0.8
    assert done.best == "Decision Tree" and done.holdout.first()["Accuracy"] > 0.7


def test_a_slow_model_does_not_hold_up_the_others(spark, flowers):
    class Endless:
        def fit(self, rows):
            spark.range(1 << 42).agg(F.sum(F.hash("id"))).collect()

    ready, _, labels = training.assembled(flowers, ["length", "width"], "kind", "classification")
    data = training.materialise(training.with_folds(ready, ["id"], 2, 1).select("features", "label", "fold"), "vectors")
    models = {"Endless": Endless(), "Decision Tree": training.classifiers(2, 2)["Decision Tree"]}
    means, errors, _ = training.cross_validate(data, models, "classification", len(labels), folds=2, limit=20)
    assert [r["Model"] for r in means.collect()] == ["Decision Tree"] and errors == {"Endless": "took longer than 20 s"}
    assert spark.range(10).count() == 10


def test_a_large_frame_of_one_file_is_fitted_in_many_parts(flowers, monkeypatch):
    seen, validate = [], training.cross_validate
    monkeypatch.setattr(training, "cross_validate", lambda data, *rest: seen.append(data) or validate(data, *rest))
    train = lambda: training.train_leaderboard(flowers.coalesce(1), "price", "regression", ["id"], ["length", "width"], include=["Linear Regression"])
    whole = {r["Model"]: r["MAE"] for r in train().leaderboard.collect()}
    monkeypatch.setattr(training, "PART_ROWS", 16, raising=False)
    parts = {r["Model"]: r["MAE"] for r in train().leaderboard.collect()}
    counts = [r["count"] for r in seen[1].groupBy(F.spark_partition_id()).count().collect()]
    assert seen[0].count() == sum(counts) and len(counts) > 6 and max(counts) <= 40
    assert all(math.isclose(parts[m], whole[m], rel_tol=1e-9) for m in whole)
