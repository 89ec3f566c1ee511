"""Training, comparing and applying models."""

from __future__ import annotations

import itertools
import random
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (
    FeatureHasher,
    Imputer,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from tabsmith.functions.columns import col, date_columns, md5_number, numeric_columns, quote, string_columns
from tabsmith.functions.date_rules import DATE_PARTS
from tabsmith.operators.clean import align_columns, drop_index_columns, drop_null_keys, require_unique_columns
from tabsmith.operators.frequency import categories
from tabsmith.operators.neighbours import nearest_means, nearest_votes, vector
from tabsmith.operators.ordered import POS, with_position
from tabsmith.operators.scores import (
    AUTO_METRIC,
    LESS_IS_BETTER,
    auc,
    classification_metrics,
    leaderboard,
    regression_metrics,
)
from tabsmith.operators.selection import validate_target
from tabsmith.session import materialise

#: Rows of a file of vectors, and the least and most files of a table; tables of up to four times the rows stay as they
#: were read, very large ones have larger files. A task reads several files, so a few would not go evenly into the cores.
PART_ROWS, LEAST_PARTS, MOST_PARTS, LARGE_PART_ROWS = 16_384, 64, 1024, 1 << 20
MOST_CATEGORIES = 25
HASH_SLOTS = 256
CLASS_METRICS = ["Accuracy", "AUC", "Recall", "Prec", "F1", "Kappa", "MCC"]
NUMBER_METRICS = ["MAE", "MSE", "RMSE", "R2", "RMSLE", "MAPE"]
# What a model can raise while it is fitted or applied; the others go on.
FIT_ERRORS = (PySparkException, Py4JJavaError, ValueError, ArithmeticError)


def split(df: DataFrame, keys: list[str], train: float = 0.8, seed: int = 123) -> tuple[DataFrame, DataFrame]:
    """M6: training and test rows by a seeded hash of the keys; repeatable."""
    if not 0.1 <= train <= 0.9:
        raise ValueError("train share must lie in 0.1-0.9")
    slot = md5_number(*[col(k) for k in keys], F.lit(seed)) % 10_000
    return df.filter(slot < int(train * 10_000)), df.filter(slot >= int(train * 10_000))


def feature_stages(
    df: DataFrame, features: list[str], most_categories: int = MOST_CATEGORIES, hash_slots: int = HASH_SLOTS
) -> list:
    """Stages from raw columns to one vector; all fitted values are bounded.

    Numbers get their mean for nulls, dates become parts, texts with up to
    `most_categories` values are one-hot encoded and other texts are hashed to
    `hash_slots` columns, so no list of labels grows with the data. Values that
    share a slot are one to the models; both bounds are the caller's choice.
    """
    numbers = [c for c in features if c in numeric_columns(df)]
    dates = [c for c in features if c in date_columns(df)]
    texts = [c for c in features if c in string_columns(df)]
    few = [c for c in texts if c in categories(df, texts, most_categories)]
    many = [c for c in texts if c not in few]
    sql = {"year": "year", "month": "month", "day": "dayofmonth", "dayofweek": "weekday", "quarter": "quarter"}
    parts = [f"cast({quote(c)} as double) as {quote('n_' + c)}" for c in numbers]
    parts += [f"cast({sql[p]}({quote(c)}) as double) as {quote(f'n_{c}_{p}')}" for c in dates for p in DATE_PARTS]
    parts += [f"coalesce({quote(c)}, 'missing') as {quote('t_' + c)}" for c in texts]
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")] if parts else []
    plain = [f"n_{c}" for c in numbers] + [f"n_{c}_{p}" for c in dates for p in DATE_PARTS]
    inputs = []
    if plain:
        stages.append(Imputer(strategy="mean", inputCols=plain, outputCols=[f"i_{c}" for c in plain]))
        inputs += [f"i_{c}" for c in plain]
    if few:
        index = [f"x_{c}" for c in few]
        stages.append(StringIndexer(inputCols=[f"t_{c}" for c in few], outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=index, outputCols=[f"o_{c}" for c in few], handleInvalid="keep"))
        inputs += [f"o_{c}" for c in few]
    if many:
        stages.append(FeatureHasher(inputCols=[f"t_{c}" for c in many], outputCol="h_texts", numFeatures=hash_slots))
        inputs.append("h_texts")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


def classifiers(classes: int, width: int, seed: int = 123) -> dict:
    """Name to estimator; two-class learners are wrapped for more classes."""
    wrap = (lambda e: e) if classes == 2 else (lambda e: OneVsRest(classifier=e))
    return {
        "Logistic Regression": LogisticRegression(),
        "Ridge Classifier": LogisticRegression(regParam=1.0, elasticNetParam=0.0),
        "Decision Tree": DecisionTreeClassifier(seed=seed),
        "Random Forest": RandomForestClassifier(seed=seed, numTrees=50),
        "Gradient Boosting": wrap(GBTClassifier(seed=seed, maxIter=20)),
        "Linear SVM": wrap(LinearSVC(regParam=0.01)),
        "Naive Bayes": NaiveBayes(modelType="gaussian"),
        "MLP": MultilayerPerceptronClassifier(layers=[width, 16, classes], seed=seed, maxIter=50),
        "K Neighbors": Neighbours("classification", classes),
    }


def regressors(seed: int = 123) -> dict:
    return {
        "Linear Regression": LinearRegression(),
        "Ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0),
        "Lasso": LinearRegression(regParam=1.0, elasticNetParam=1.0),
        "Elastic Net": LinearRegression(regParam=1.0, elasticNetParam=0.5),
        "Huber": LinearRegression(loss="huber", maxIter=50),
        "Decision Tree": DecisionTreeRegressor(seed=seed),
        "Random Forest": RandomForestRegressor(seed=seed, numTrees=50),
        "Gradient Boosting": GBTRegressor(seed=seed, maxIter=20),
        "K Neighbors": Neighbours("regression"),
    }


class Neighbours:
    """K Neighbors over assembled vectors, with the fit and transform of an estimator.

    The search is the exact one of the imputer and takes the vector as it is, so
    the plan does not grow with its slots. There is nothing to save but the
    training rows, so the model is ranked but never the one that is kept.
    """

    def __init__(self, task: str, classes: int = 0, k: int = 5):
        self.task, self.classes, self.k, self.rows = task, classes, k, None

    def fit(self, rows: DataFrame) -> Neighbours:
        fitted = Neighbours(self.task, self.classes, self.k)
        value = F.array("label")
        if self.task != "regression":
            value = F.transform(F.sequence(F.lit(0), F.lit(self.classes - 1)), lambda i: (F.col("label") == i).cast("double"))
        fitted.rows = rows.select(vector_to_array("features").alias("x"), F.array(value).alias("choices"))
        return fitted

    def transform(self, rows: DataFrame) -> DataFrame:
        plain = rows.withColumn("_x", vector_to_array("features"))
        found = nearest_means(plain.select(F.col("_x").alias("x")), self.rows, self.k).withColumnRenamed("x", "_near")
        if self.task == "regression":
            out = [F.get("means", F.lit(0)).alias("prediction")]
        else:
            best = F.array_position("means", F.array_max("means")) - 1
            out = [best.cast("double").alias("prediction"), F.col("means").alias("scores")]
        return plain.join(found, _alike("_x", "_near"), "left").select(*rows.columns, *out)


def _alike(a: str, b: str) -> Column:
    """Equal arrays, by their hashes first, for arrays are slow to put in order."""
    return (F.xxhash64(a) == F.xxhash64(b)) & (F.col(a) == F.col(b))


# --- scoring of folds ---------------------------------------------------------------

def with_folds(df: DataFrame, keys: list[str], folds: int, seed: int) -> DataFrame:
    """Add `fold` by the hash that `split` takes, so that other engines have the same folds."""
    return df.withColumn("fold", (md5_number(*[col(k) for k in keys], F.lit(seed + 1)) % folds).cast("int"))


def _predictions(model, rows: DataFrame, name: str) -> DataFrame:
    """(Model, fold, label, prediction, scores) of held-out rows; `scores` has a value per class."""
    scored = model.transform(rows)
    rating = next((c for c in ("probability", "rawPrediction") if c in scored.columns), None)
    value = vector_to_array(rating) if rating else F.lit(None).cast("array<double>")
    if "scores" in scored.columns:
        value = F.col("scores")
    return scored.select(F.lit(name).alias("Model"), "fold", "label", "prediction", value.alias("scores"))


def class_auc(held: DataFrame, classes: int, by: list[str]) -> DataFrame:
    """AUC of (label, scores): the second class's for two classes, else the
    mean over one-versus-rest areas, weighted by the rows of each class."""
    if classes == 2:
        return auc(held.withColumn("score", F.get("scores", F.lit(1))), F.col("label") == 1, "score", by)
    each = held.select(*by, "label", F.posexplode("scores").alias("class", "score"))
    area = auc(each, F.col("label") == F.col("class"), "score", [*by, "class"])
    weight = held.groupBy(*by, F.col("label").cast("int").alias("class")).agg(F.count("*").alias("n"))
    joined = area.join(weight, [*by, "class"]).filter("AUC is not null")
    return joined.groupBy(*by).agg((F.sum(F.col("AUC") * F.col("n")) / F.sum("n")).alias("AUC"))


def fold_metrics(held: DataFrame, task: str, classes: int, by: list[str]) -> DataFrame:
    """All metrics of the task over (label, prediction, scores)."""
    if task == "regression":
        return regression_metrics(held, "label", "prediction", by)
    found = classification_metrics(held, "label", "prediction", by)
    return found.join(class_auc(held.filter("scores is not null"), classes, by), by, "left")


@contextmanager
def time_limit(spark, seconds: float | None):
    """Cancel the jobs that this thread starts once they take longer; the one that runs then raises."""
    if seconds is None:
        yield
        return
    context, group = spark.sparkContext, f"limit-{uuid.uuid4().hex}"
    context.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    over = threading.Event()

    def watch():
        # Again and again, for a model may start its next job.
        if not over.wait(seconds):
            while not over.wait(0.2):
                context.cancelJobGroup(group)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", None)


def cross_validate(data: DataFrame, models: dict, task: str, classes: int, folds: int = 3, parallelism: int = 4, limit: float | None = None):
    """M7: mean metrics of each model over the folds of `data` (features,
    label, fold); a dict of errors and one of training seconds come along.

    All fits run side by side, then all predictions, which are written and
    scored in one grouped pass. A model that fails in either is left out, and so
    is one that takes more than `limit` seconds for a fit or a prediction; with
    a limit models run one after another, so that none waits for another's
    tasks while its own time runs.
    """
    errors, seconds = {}, dict.fromkeys(models, 0.0)

    def reason(problem: Exception, begin: float) -> str:
        if limit is not None and time.time() - begin >= limit:
            return f"took longer than {limit} s"
        return str(problem).splitlines()[0][:200]

    def fit(job):
        name, k = job
        begin = time.time()
        if name in errors:
            return name, k, None, 0.0
        try:
            with time_limit(data.sparkSession, limit):
                return name, k, models[name].fit(data.filter(F.col("fold") != k)), time.time() - begin
        except FIT_ERRORS as problem:
            errors[name] = reason(problem, begin)
            return name, k, None, 0.0

    def predict(job):
        name, k, model = job
        begin = time.time()
        try:
            with time_limit(data.sparkSession, limit):
                return materialise(_predictions(model, data.filter(F.col("fold") == k), name), "predictions")
        except FIT_ERRORS as problem:
            errors[name] = reason(problem, begin)

    with ThreadPool(parallelism if limit is None else 1) as pool:
        jobs = [(n, k) for n in models for k in range(folds)]
        fitted = pool.map(inheritable_thread_target(data.sparkSession)(fit), jobs, chunksize=1)
        for name, _, _, took in fitted:
            seconds[name] += took
        jobs = [(n, k, m) for n, k, m, _ in fitted if n not in errors]
        held = list(zip(jobs, pool.map(inheritable_thread_target(data.sparkSession)(predict), jobs, chunksize=1)))
    parts = [rows for (name, _, _), rows in held if rows is not None and name not in errors]
    if not parts:
        return None, errors, seconds
    scores = fold_metrics(reduce(DataFrame.unionAll, parts), task, classes, ["Model", "fold"])
    names = CLASS_METRICS if task == "classification" else NUMBER_METRICS
    return scores.groupBy("Model").agg(*[F.avg(m).alias(m) for m in names]), errors, seconds


def neighbour_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, task: str, k: int = 5) -> DataFrame:
    """K Neighbors for both tasks: test features with `label` and `prediction`.

    The exact neighbour search of the imputer with the target as the value.
    Classes are numbered in order by a joined table and their votes are counted
    in groups, so there may be any number of them; the first one wins a tie.
    """
    plain = test.select(*[col(c).cast("double").alias(c) for c in features], col(target).alias("label"))
    plain = plain.withColumn("_x", vector([col(c) for c in features]))
    asked = plain.select(F.col("_x").alias("x"))
    x = vector([col(c) for c in features]).alias("x")
    choice = lambda v: F.array(F.when(v.isNotNull(), F.array(v.cast("double")))).alias("choices")
    if task == "regression":
        found = nearest_means(asked, train.select(x, choice(col(target))), k)
        value = F.get("means", F.lit(0))
    else:
        classes = train.select(col(target).alias("_class")).filter("_class is not null").distinct()
        classes = materialise(with_position(classes, [], "_class").select("_class", F.col(POS).cast("double").alias("_code")), "classes")
        coded = train.join(classes, col(target) == F.col("_class"))
        found = nearest_votes(asked, coded.select(x, choice(F.col("_code"))), k).join(classes, F.col("vote") == F.col("_code"))
        value = F.col("_class")
    keyed = found.select(F.col("x").alias("_near"), value.alias("prediction"))
    return plain.join(keyed, _alike("_x", "_near"), "left").select(*[col(c) for c in features], "label", "prediction")


# --- the whole flow -------------------------------------------------------------------

@dataclass
class Trained:
    leaderboard: DataFrame
    best: str
    model: PipelineModel
    labels: list[str]
    features: list[str]
    task: str
    holdout: DataFrame


def checked(df: DataFrame, target: str, task: str) -> DataFrame:
    """Rows and columns fit for training; raises on a hopeless target."""
    clean = drop_null_keys(drop_index_columns(require_unique_columns(df)), [target])
    verdict = validate_target(clean, target, task).first()
    if verdict["level"] == "error":
        raise ValueError(verdict["message"])
    return clean


def label_stage(df: DataFrame, target: str) -> tuple[StringIndexerModel, list[str]]:
    """Label indexer over the sorted classes; every model holds a number per class anyway."""
    found = df.select(col(target).cast("string")).distinct().collect()
    labels = sorted(str(r[0]) for r in found)
    model = StringIndexerModel.from_labels(labels, inputCol="_label_text", outputCol="label", handleInvalid="error")
    return model, labels


def dealt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a large frame in even parts, whatever files they come from, so that a fit uses all cores.

    Rows of a part are put in order, because trees draw samples by place.
    """
    rows = df.count()
    if rows <= 4 * PART_ROWS:
        return df
    parts = max(LEAST_PARTS, min(-(-rows // PART_ROWS), MOST_PARTS), -(-rows // LARGE_PART_ROWS))
    known = {*numeric_columns(df), *date_columns(df), *string_columns(df)}
    return df.repartition(parts).sortWithinPartitions(*[col(c) for c in dict.fromkeys(columns) if c in known])


def assembled(df: DataFrame, features: list[str], target: str, task: str) -> tuple[DataFrame, PipelineModel, list[str]]:
    """(features, label) rows, the fitted feature stages and the class labels."""
    stages = Pipeline(stages=feature_stages(df, features)).fit(df)
    ready = stages.transform(df)
    if task == "classification":
        indexer, labels = label_stage(df, target)
        ready = indexer.transform(ready.withColumn("_label_text", col(target).cast("string")))
    else:
        labels = []
        ready = ready.withColumn("label", col(target).cast("double"))
    return ready, stages, labels


def train_leaderboard(
    df: DataFrame,
    target: str,
    task: str,
    keys: list[str],
    features: list[str] | None = None,
    metric: str = "auto",
    train: float = 0.8,
    folds: int = 3,
    seed: int = 123,
    include: list[str] | None = None,
    parallelism: int = 4,
    limit: float | None = None,
) -> Trained:
    """Check, split, cross-validate every model, rank, refit the best.

    The assembled vectors are written once and read by every model. A model
    that cannot be fitted or applied, or takes longer than `limit` seconds for
    a fold, is listed with its error. The best model
    that can be saved is scored on the rows left out, then fitted on all.
    """
    clean = checked(df, target, task)
    features = features or [c for c in clean.columns if c not in keys and c != target]
    kept, rest = split(clean, keys, train, seed)
    ready, stages, labels = assembled(kept, features, target, task)
    ready = dealt(ready, [*keys, *features, target])
    data = materialise(with_folds(ready, keys, folds, seed).select("features", "label", "fold"), "vectors")
    width = data.first()["features"].size
    models = classifiers(len(labels), width, seed) if task == "classification" else regressors(seed)
    models = {n: m for n, m in models.items() if include is None or n in include}
    names = CLASS_METRICS if task == "classification" else NUMBER_METRICS
    means, errors, seconds = cross_validate(data, models, task, len(labels), folds, parallelism, limit)
    found = {r["Model"]: r.asDict() for r in means.collect()} if means is not None else {}
    rows = [
        (n, *[_number(found.get(n, {}).get(m)) for m in names], errors.get(n), seconds[n]) for n in models
    ]
    rows.append(("Dummy", *_dummy(data, task, names), None, 0.0))
    kinds = ", ".join(f"{m} double" for m in names)
    results = df.sparkSession.createDataFrame(rows, f"Model string, {kinds}, error string, TT double")
    metric = AUTO_METRIC[task] if metric == "auto" else metric
    sign = 1 if metric in LESS_IS_BETTER else -1
    place = names.index(metric) + 1
    fitted = [r for r in rows if r[place] is not None and r[0] != "Dummy" and not isinstance(models[r[0]], Neighbours)]
    if not fitted:
        raise ValueError("no model could be fitted")
    best = min(fitted, key=lambda r: (sign * r[place], r[0]))[0]
    tested = stages.transform(rest)
    if task == "classification":
        known = F.array_position(F.lit(labels), col(target).cast("string")) - 1
        tested = tested.withColumn("label", F.when(known >= 0, known.cast("double")))
    else:
        tested = tested.withColumn("label", col(target).cast("double"))
    tested = materialise(tested.filter("label is not null").select("features", "label", F.lit(0).alias("fold")), "holdout")
    held = materialise(_predictions(models[best].fit(data), tested, best), "predictions")
    holdout = fold_metrics(held, task, len(labels), ["Model"]).select("Model", *names)
    model = finalise(clean, features, target, task, models[best])
    return Trained(leaderboard(results, metric), best, model, labels, features, task, holdout)


def _number(value):
    return None if value is None or value != value else float(value)


def _dummy(data: DataFrame, task: str, names: list[str]) -> list:
    if task == "classification":
        top = data.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
        found = classification_metrics(data.withColumn("prediction", F.lit(top)), "label", "prediction").first().asDict()
        found["AUC"] = 0.5
    else:
        mean = data.agg(F.avg("label")).first()[0]
        found = regression_metrics(data.withColumn("prediction", F.lit(mean)), "label", "prediction").first().asDict()
    return [_number(found.get(m)) for m in names]


def finalise(df: DataFrame, features: list[str], target: str, task: str, estimator) -> PipelineModel:
    """Refit feature stages and model on all rows; one saveable model."""
    ready, stages, _ = assembled(df, features, target, task)
    ready = materialise(dealt(ready, [*features, target]).select("features", "label"), "vectors")
    return PipelineModel(stages=[*stages.stages, estimator.fit(ready)])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(df: DataFrame, model: PipelineModel, features: dict[str, str] | list[str], labels: list[str] = ()) -> DataFrame:
    """Predictions for new rows. A missing feature is an error, further
    columns are carried along; confidence is the highest class probability."""
    align_columns(df, features, strict=True)
    scored = model.transform(df)
    out = F.col("prediction")
    if labels:
        out = F.get(F.array(*map(F.lit, labels)), F.col("prediction").cast("int"))
    added = [out.alias("prediction")]
    if "probability" in scored.columns:
        added.append(F.array_max(vector_to_array("probability")).alias("confidence"))
    return scored.select(*[col(c) for c in df.columns], *added)


# Settings tried by the random search.
SEARCH = {
    "Decision Tree": {"maxDepth": [2, 3, 5, 8, 10], "minInstancesPerNode": [1, 2, 5, 10]},
    "Random Forest": {"numTrees": [10, 20, 50], "maxDepth": [3, 5, 8, 10], "minInstancesPerNode": [1, 2, 5]},
    "Logistic Regression": {"regParam": [0.0, 0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "Ridge Classifier": {"regParam": [0.01, 0.1, 0.5, 1.0, 2.0, 5.0]},
    "Naive Bayes": {"smoothing": [0.1, 0.5, 1.0, 2.0]},
    "Linear Regression": {"regParam": [0.0, 0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "Ridge": {"regParam": [0.01, 0.1, 0.5, 1.0, 2.0, 5.0]},
    "Lasso": {"regParam": [0.001, 0.01, 0.1, 1.0]},
    "Elastic Net": {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.2, 0.5, 0.8]},
    "Huber": {"epsilon": [1.1, 1.35, 1.5, 2.0], "regParam": [0.0, 0.01, 0.1]},
    "Gradient Boosting": {"maxIter": [10, 20], "maxDepth": [2, 3, 5], "stepSize": [0.05, 0.1, 0.3]},
}


def tune(data: DataFrame, name: str, estimator, task: str, n_iter: int = 10, folds: int = 3, seed: int = 123, metric: str | None = None):
    """Random search over the settings of a model; (best model, its
    settings, mean metric). `data` holds features, label and fold."""
    space = SEARCH.get(name, {})
    every = list(itertools.product(*space.values()))
    picked = random.Random(seed).sample(every, min(n_iter, len(every)))
    maps = [{estimator.getParam(p): v for p, v in zip(space, values)} for values in picked] or ParamGridBuilder().build()
    if task == "classification":
        evaluator = MulticlassClassificationEvaluator(metricName=metric or "accuracy")
    else:
        evaluator = RegressionEvaluator(metricName=metric or "r2")
    search = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=4)
    fitted = search.fit(data)
    sign = 1 if evaluator.isLargerBetter() else -1
    best = max(range(len(maps)), key=lambda i: (sign * fitted.avgMetrics[i], -i))
    return fitted.bestModel, {p.name: v for p, v in maps[best].items()}, float(fitted.avgMetrics[best])
