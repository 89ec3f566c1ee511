"""Queries for feature selection, training and scoring (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import scores, selection
from tabsmith.operators.information import neighbour_information
from tabsmith.plans import training
from tabsmith.queries.features import codes_sql
from tabsmith.queries.fixtures import GAPPY_ORDERS, gappy_orders
from tabsmith.queries.profiling import rounded
from tabsmith.queries.registry import query
from tabsmith.session import materialise, scratch_path

FEATURES = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus"]


def mi_sql(table: str, features: list[tuple[str, bool]], target: str, target_binned: bool) -> str:
    """Plug-in mutual information over the same bins."""
    parts = []
    for f, binned in features:
        x = f"(SELECT *, CAST({f}_binned AS VARCHAR) AS x FROM {codes_sql('u', f, 10)})" if binned else f"(SELECT *, CAST({f} AS VARCHAR) AS x FROM u)"
        parts.append(f"SELECT '{f}' AS feature, coalesce(x, 'missing') AS x, y, count(*) AS n FROM {x} GROUP BY 1, 2, 3")
    y = f"CAST({target}_binned AS VARCHAR)" if target_binned else f"CAST({target} AS VARCHAR)"
    source = codes_sql(table, target, 10) if target_binned else table
    return f"""WITH u AS (SELECT *, {y} AS y FROM {source}), j AS ({' UNION ALL '.join(parts)}),
    m AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nt FROM j)
    SELECT feature, greatest(sum(n / nt * ln(n::DOUBLE * nt / (nx::DOUBLE * ny))), 0) AS importance FROM m GROUP BY 1"""


CLASS_MI = mi_sql("lineitem", [("l_linenumber", False), ("l_quantity", True), ("l_discount", True), ("l_tax", False), ("l_linestatus", False)], "l_returnflag", False)
NUMBER_MI = mi_sql("lineitem", [("l_linenumber", False), ("l_quantity", True), ("l_discount", True), ("l_tax", False), ("l_linestatus", False)], "l_extendedprice", True)


@query("m1_mutual_information_class", f"SELECT feature, round(importance, 6) AS importance FROM ({CLASS_MI})")
def information(t):
    return rounded(selection.mutual_information(t.lineitem, FEATURES, "l_returnflag"), ["importance"], 6)


@query("m1_mutual_information_number", f"SELECT feature, round(importance, 6) AS importance FROM ({NUMBER_MI})")
def information_number(t):
    return rounded(selection.mutual_information(t.lineitem, FEATURES, "l_extendedprice"), ["importance"], 6)


def digamma_sql(n: str) -> str:
    """Harmonic numbers up to 1000, the series beyond."""
    return f"""CASE WHEN {n} <= 1000 THEN list_sum([0.0::DOUBLE] || list_transform(range(1, {n}::BIGINT), lambda i: 1.0::DOUBLE / i)) - 0.5772156649015328606::DOUBLE
      ELSE ln({n}) - 1 / (2.0::DOUBLE * {n}) - 1 / (12.0::DOUBLE * {n} * {n}) END"""


def near_sql(table: str, features: dict[str, str], target: str, k: int = 3) -> str:
    """The neighbour estimate from all pairs of rows."""
    lines = " UNION ALL ".join(f"SELECT '{f}' AS feature, row_number() OVER () AS id, y, {x}::DOUBLE AS x FROM u" for f, x in features.items())
    return f"""WITH u AS (SELECT *, count(*) OVER (PARTITION BY y) AS n FROM (SELECT *, {target} AS y FROM {table}) QUALIFY n > 1),
    s AS (SELECT feature, id, y, x, count(*) OVER (PARTITION BY feature, y) AS n, count(*) OVER (PARTITION BY feature) AS rows FROM ({lines})),
    d AS (SELECT a.feature, a.id, a.x, a.n, a.rows, abs(a.x - b.x) AS d, least({k}, a.n - 1) AS k, row_number() OVER (PARTITION BY a.feature, a.id ORDER BY abs(a.x - b.x)) AS place
      FROM s a JOIN s b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id),
    r AS (SELECT d.*, s.y FROM d JOIN s USING (feature, id) WHERE place = d.k),
    m AS (SELECT r.feature, r.id, any_value(r.n) AS n, any_value(CASE WHEN r.d = 0 THEN NULL ELSE r.k END) AS far, count(*) FILTER (s.y = r.y) AS own, any_value(r.rows) AS rows, count(*) AS m
      FROM r JOIN s ON r.feature = s.feature AND CASE WHEN r.d = 0 THEN s.x = r.x ELSE abs(s.x - r.x) < r.d * (1 - 1e-6) END GROUP BY 1, 2)
    SELECT feature, greatest(0, any_value({digamma_sql("rows")}) + avg({digamma_sql("coalesce(far, own)")} - ({digamma_sql("n")}) - ({digamma_sql("m")}))) AS importance FROM m GROUP BY feature"""


NEAR_FEATURES = {
    "p_partkey": "p_partkey", "p_size": "p_size", "p_retailprice": "p_retailprice", "p_type": "(SELECT count(DISTINCT p_type) FROM part q WHERE q.p_type < u.p_type)",
}


@query("m1_neighbour_information", f"SELECT feature, round(importance, 6) AS importance FROM ({near_sql('part', NEAR_FEATURES, 'p_brand')})")
def information_near(t):
    return rounded(neighbour_information(t.part, list(NEAR_FEATURES), "p_brand"), ["importance"], 6)


@query("m1_neighbour_information_chunks", f"SELECT feature, round(importance, 6) AS importance FROM ({near_sql('part', NEAR_FEATURES, 'p_brand')})")
def information_near_chunks(t):
    """The same with lines cut into chunks, as long ones are."""
    return rounded(neighbour_information(t.part, list(NEAR_FEATURES), "p_brand", chunk_rows=300), ["importance"], 6)


@query(
    "m2_correlation_importance",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 4) AS importance FROM lineitem" for c in FEATURES[:4]) + ")",
)
def correlation(t):
    return rounded(selection.correlation_importance(t.lineitem, FEATURES[:4], "l_extendedprice"), ["importance"])


RANKED = f"""SELECT CAST(row_number() OVER o AS INTEGER) AS rank, feature, importance, importance / sum(importance) OVER () * 100 AS relative_percent,
  sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) / sum(importance) OVER () * 100 AS cumulative_percent,
  CASE WHEN feature = 'l_linestatus' THEN 'categorical' ELSE 'numeric' END AS feature_type, 0::BIGINT AS missing,
  (SELECT CASE feature WHEN 'l_linenumber' THEN count(DISTINCT l_linenumber) WHEN 'l_quantity' THEN count(DISTINCT l_quantity) WHEN 'l_discount' THEN count(DISTINCT l_discount)
     WHEN 'l_tax' THEN count(DISTINCT l_tax) ELSE count(DISTINCT l_linestatus) END FROM lineitem) AS "distinct"
  FROM ({NUMBER_MI}) WINDOW o AS (ORDER BY importance DESC, feature)"""
ROUND_RANKED = 'SELECT rank, feature, round(importance, 6) AS importance, round(relative_percent, 4) AS relative_percent, round(cumulative_percent, 4) AS cumulative_percent, feature_type, missing, "distinct"'


def ranked(t):
    return selection.rank_features(t.lineitem, selection.mutual_information(t.lineitem, FEATURES, "l_extendedprice"))


def tidy(df):
    return rounded(rounded(df, ["importance"], 6), ["relative_percent", "cumulative_percent"])


@query("m3_rank_features", f"{ROUND_RANKED} FROM ({RANKED})")
def rank(t):
    return tidy(ranked(t))


@query("m4_recommend_features", f"{ROUND_RANKED} FROM ({RANKED}) WHERE ((cumulative_percent - relative_percent) / 100 < 0.8 AND rank <= 10) OR rank <= 3")
def recommend(t):
    return tidy(selection.recommend_features(ranked(t)))


@query("m4_features_within", f"{ROUND_RANKED} FROM ({RANKED}) WHERE cumulative_percent / 100 <= 0.99")
def within(t):
    return tidy(selection.features_within(ranked(t), 0.99))


@query(
    "m5_validate_target",
    """SELECT 'l_returnflag' AS target, 'ok' AS level, 'class target' AS message, count(DISTINCT l_returnflag) AS classes FROM lineitem
    UNION ALL SELECT 'l_quantity', 'warning', CASE WHEN count(DISTINCT l_quantity) > 50 THEN 'more than 50 classes, this looks like regression' ELSE 'more than 20 classes' END, count(DISTINCT l_quantity) FROM lineitem
    UNION ALL SELECT 'l_linestatus', 'error', 'regression needs a numeric target', count(DISTINCT l_linestatus) FROM lineitem""",
)
def target(t):
    checks = [("l_returnflag", "classification"), ("l_quantity", "classification"), ("l_linestatus", "regression")]
    frames = [selection.validate_target(t.lineitem, c, task).select(F.lit(c).alias("target"), "*") for c, task in checks]
    return frames[0].unionAll(frames[1]).unionAll(frames[2])


@query(
    "m6_split",
    """SELECT o_orderkey, CASE WHEN CAST('0x' || substring(md5(o_orderkey || chr(1) || '123'), 1, 8) AS BIGINT) % 10000 < 8000 THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def parts(t):
    train, test = training.split(t.orders, ["o_orderkey"])
    return train.select("o_orderkey", F.lit("train").alias("part")).unionAll(test.select("o_orderkey", F.lit("test").alias("part")))


def guessed(t):
    """A fixed rule as the classifier, so that SQL can make the same guesses."""
    q = F.col("l_quantity")
    return t.lineitem.select(
        F.col("l_returnflag").alias("label"),
        F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("prediction"),
        (F.col("l_discount") + q / 100).alias("score"),
    )


GUESSED = "SELECT l_returnflag AS y, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p, l_discount + l_quantity / 100 AS s FROM lineitem"


@query(
    "m8_classification_metrics",
    f"""WITH g AS ({GUESSED}), k AS (SELECT DISTINCT y AS k FROM g UNION SELECT DISTINCT p FROM g),
    c AS (SELECT k, count(*) FILTER (y = k)::DOUBLE AS support, count(*) FILTER (p = k)::DOUBLE AS guessed, count(*) FILTER (y = k AND p = k)::DOUBLE AS hit FROM g, k GROUP BY k),
    r AS (SELECT *, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS prec FROM c),
    o AS (SELECT sum(support) AS n, sum(hit) AS c, sum(support * recall) AS r, sum(support * prec) AS p, sum(support * CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0 END) AS f,
      sum(support * guessed) AS sg, sum(support * support) AS ss, sum(guessed * guessed) AS gg FROM r)
    SELECT round(c / n, 6) AS "Accuracy", round(r / n, 6) AS "Recall", round(p / n, 6) AS "Prec", round(f / n, 6) AS "F1", round((c / n - sg / (n * n)) / (1 - sg / (n * n)), 6) AS "Kappa",
      round((c * n - sg) / sqrt((n * n - ss) * (n * n - gg)), 6) AS "MCC" FROM o""",
)
def class_metrics(t):
    found = scores.classification_metrics(guessed(t), "label", "prediction")
    return rounded(found, found.columns, 6)


AUC_SQL = f"""WITH g AS ({GUESSED}), d AS (SELECT s, count(*) FILTER (y = 'R')::DOUBLE AS pos, count(*) FILTER (y <> 'R')::DOUBLE AS neg FROM g GROUP BY s),
    r AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM d)
    SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS "AUC" FROM r"""


@query("m8_auc", AUC_SQL)
def area(t):
    return rounded(scores.auc(guessed(t), F.col("label") == "R", "score"), ["AUC"], 6)


@query("m8_auc_chunks", AUC_SQL)
def area_chunks(t):
    """The same with the scores ranked in chunks, as many scores are."""
    return rounded(scores.auc(guessed(t), F.col("label") == "R", "score", chunk_rows=100), ["AUC"], 6)


@query(
    "m9_regression_metrics",
    """WITH g AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem)
    SELECT l_returnflag, round(avg(abs(y - p)), 4) AS "MAE", round(avg((y - p) * (y - p)), 0) AS "MSE", round(sqrt(avg((y - p) * (y - p))), 4) AS "RMSE",
      round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS "R2", round(sqrt(avg((ln(1 + abs(p)) - ln(1 + abs(y))) * (ln(1 + abs(p)) - ln(1 + abs(y))))), 6) AS "RMSLE",
      round(avg(abs((y - p) / nullif(y, 0))), 6) AS "MAPE" FROM g GROUP BY 1""",
)
def number_metrics(t):
    g = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    found = scores.regression_metrics(g, "y", "p", ["l_returnflag"])
    return rounded(rounded(rounded(found, ["MAE", "RMSE"]), ["R2", "RMSLE", "MAPE"], 6), ["MSE"], 0)


RULES = {"mean": "avg_price", "quantity": "l_quantity * 1500.0", "flat": "40000.0"}


@query(
    "m10_leaderboard",
    """WITH a AS (SELECT avg(l_extendedprice) AS m FROM lineitem),
    e AS (SELECT 'mean' AS "Model", avg(abs(l_extendedprice - m)) AS v FROM lineitem, a UNION ALL SELECT 'quantity', avg(abs(l_extendedprice - l_quantity * 1500.0)) FROM lineitem
      UNION ALL SELECT 'flat', avg(abs(l_extendedprice - 40000.0)) FROM lineitem UNION ALL SELECT 'broken', NULL)
    SELECT CAST(row_number() OVER (ORDER BY v ASC NULLS LAST, "Model") AS INTEGER) AS rank, "Model", round(v, 4) AS "MAE" FROM e""",
)
def board(t):
    line = t.lineitem.select("l_extendedprice", "l_quantity")
    mean = scores.dummy_baseline(line, "l_extendedprice", "regression")
    guesses = {
        "mean": mean,
        "quantity": line.withColumn("prediction", F.col("l_quantity") * 1500.0),
        "flat": line.withColumn("prediction", F.lit(40000.0)),
        "broken": line.withColumn("prediction", F.lit(None).cast("double")),
    }
    rows = None
    for name, g in guesses.items():
        one = scores.regression_metrics(g, "l_extendedprice", "prediction").select(F.lit(name).alias("Model"), "MAE")
        rows = one if rows is None else rows.unionAll(one)
    return rounded(scores.leaderboard(rows, "MAE"), ["MAE"])


@query(
    "m14_dummy_classification",
    f"""WITH g AS ({GAPPY_ORDERS}) SELECT o_orderkey, o_orderstatus, (SELECT o_orderstatus FROM g WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction FROM g""",
)
def majority(t):
    return scores.dummy_baseline(gappy_orders(t).select("o_orderkey", "o_orderstatus"), "o_orderstatus", "classification")


@query("m14_dummy_regression", "SELECT p_partkey, p_retailprice, round((SELECT avg(p_retailprice) FROM part), 4) AS prediction FROM part")
def mean(t):
    return rounded(scores.dummy_baseline(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", "regression"), ["prediction"])


# --- models ---------------------------------------------------------------------------

def documents(t):
    """Labelled documents: a class target with numbers and categories."""
    text = F.col("text")
    facts = t.documents.select(
        "doc_id", "lang", "source", "n_chars",
        (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.greatest(F.length(text), F.lit(1))).alias("letters"),
        F.size(F.split(text, "\n")).alias("lines"),
        F.size(F.split(text, " ")).alias("words"),
    )
    return facts.join(t.labels.select("doc_id", "quality"), "doc_id")


DOC_FEATURES = ["lang", "source", "n_chars", "letters", "lines", "words"]
PART_FEATURES = ["p_brand", "p_type", "p_size", "p_partkey"]


@query("m7_cross_validate")
def validated(t):
    ready, _, labels = training.assembled(documents(t), DOC_FEATURES, "quality", "classification")
    data = materialise(training.with_folds(ready, ["doc_id"], 3, 123).select("features", "label", "fold"), "vectors")
    every = training.classifiers(len(labels), 1)
    models = {n: every[n] for n in ("Logistic Regression", "Decision Tree", "Naive Bayes")}
    means, _, _ = training.cross_validate(data, models, "classification", len(labels))
    return rounded(means, training.CLASS_METRICS, 6)


def line_sql(source: str, by: str) -> str:
    """Least squares of y on x1 and x2 per group from their moments: (by, b0, b1, b2)."""
    return f"""SELECT {by}, my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (
      SELECT *, (c1 * s2 - c2 * s12) / (s1 * s2 - s12 * s12) AS b1, (c2 * s1 - c1 * s12) / (s1 * s2 - s12 * s12) AS b2 FROM (
        SELECT {by}, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s1, var_pop(x2) AS s2, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
        FROM ({source}) GROUP BY {by}))"""


PART_LINE = "SELECT p_partkey, p_size::DOUBLE AS x1, p_partkey::DOUBLE AS x2, p_retailprice AS y, CAST('0x' || substring(md5(p_partkey || chr(1) || '124'), 1, 8) AS BIGINT) % 3 AS fold FROM part"
NUMBERS = ["p_size", "p_partkey"]


@query(
    "m7_cross_validate_line",
    f"""WITH u AS ({PART_LINE}), l AS ({line_sql("SELECT u.*, k.k FROM u, range(3) AS k(k) WHERE u.fold <> k.k", "k")}),
    g AS (SELECT fold, y, b0 + b1 * x1 + b2 * x2 AS p FROM u JOIN l ON u.fold = l.k),
    f AS (SELECT avg(abs(y - p)) AS a, avg((y - p) * (y - p)) AS b, sqrt(avg((y - p) * (y - p))) AS c, 1 - avg((y - p) * (y - p)) / var_pop(y) AS d,
      sqrt(avg((ln(1 + abs(p)) - ln(1 + abs(y))) ** 2)) AS e, avg(abs((y - p) / nullif(y, 0))) AS f FROM g GROUP BY fold)
    SELECT 'Linear Regression' AS "Model", round(avg(a), 4) AS "MAE", round(avg(b), 4) AS "MSE", round(avg(c), 4) AS "RMSE", round(avg(d), 4) AS "R2", round(avg(e), 4) AS "RMSLE", round(avg(f), 4) AS "MAPE" FROM f""",
)
def validated_line(t):
    ready, _, _ = training.assembled(t.part, NUMBERS, "p_retailprice", "regression")
    data = materialise(training.with_folds(ready, ["p_partkey"], 3, 123).select("features", "label", "fold"), "vectors")
    means, _, _ = training.cross_validate(data, {"Linear Regression": training.regressors()["Linear Regression"]}, "regression", 0)
    return rounded(means, training.NUMBER_METRICS, 4)


@query(
    "m13_score_line",
    f"""WITH u AS ({PART_LINE}), l AS ({line_sql("SELECT *, 0 AS k FROM u", "k")})
    SELECT p_partkey, round(b0 + b1 * x1 + b2 * x2, 4) AS prediction FROM u, l""",
)
def scored_line(t):
    """Refitted on all rows, saved, loaded and applied."""
    path = scratch_path(t.spark, "model")
    model = training.finalise(t.part, NUMBERS, "p_retailprice", "regression", training.regressors()["Linear Regression"])
    training.save_model(model, path)
    return rounded(training.score(t.part, training.load_model(path), NUMBERS).select("p_partkey", "prediction"), ["prediction"])


@query("m11_tune")
def tuned(t):
    ready, _, _ = training.assembled(t.part, PART_FEATURES, "p_retailprice", "regression")
    data = materialise(training.with_folds(ready, ["p_partkey"], 3, 123).select("features", "label", "fold"), "vectors")
    _, settings, value = training.tune(data, "Ridge", training.regressors()["Ridge"], "regression", n_iter=4)
    rows = [(k, float(v)) for k, v in settings.items()] + [("r2", round(value, 6))]
    return t.spark.createDataFrame(rows, "name string, value double")


def priced(t):
    """A price model, saved, loaded and applied to all parts."""
    path = scratch_path(t.spark, "model")
    model = training.finalise(t.part, PART_FEATURES, "p_retailprice", "regression", training.regressors()["Linear Regression"])
    training.save_model(model, path)
    return training.score(t.part, training.load_model(path), PART_FEATURES)


@query("m12_finalise")
def finalised(t):
    return rounded(scores.regression_metrics(priced(t), "p_retailprice", "prediction"), training.NUMBER_METRICS, 6)


@query("m13_score")
def scored(t):
    docs = documents(t)
    model = training.finalise(docs, DOC_FEATURES, "quality", "classification", training.classifiers(2, 1)["Logistic Regression"])
    out = training.score(docs, model, DOC_FEATURES, ["0", "1"])
    return rounded(out.select("doc_id", "quality", "prediction", "confidence"), ["confidence"])


@query("m15_select_by_score")
def chosen(t):
    kept = selection.select_by_score(t.lineitem, FEATURES, "l_extendedprice", 2)
    return t.lineitem.select("l_orderkey", *sorted(kept), "l_extendedprice")


@query("m15_selected_features", f"SELECT feature FROM (SELECT *, row_number() OVER (ORDER BY round(importance, 9) DESC, feature) AS place FROM ({NUMBER_MI})) WHERE place <= 2")
def chosen_names(t):
    kept = selection.select_by_score(t.lineitem, FEATURES, "l_extendedprice", 2)
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")


def without_time(board):
    """Training times differ from run to run and are left out."""
    return rounded(board.drop("TT"), [c for c in board.columns if c not in ("rank", "Model", "error", "TT")], 6)


@query("m16_train_classification")
def classification(t):
    return without_time(training.train_leaderboard(documents(t), "quality", "classification", ["doc_id"]).leaderboard)


@query("m16_train_regression")
def regression(t):
    return without_time(
        training.train_leaderboard(t.part.drop("p_name"), "p_retailprice", "regression", ["p_partkey"], PART_FEATURES).leaderboard
    )


NEIGHBOURS = """WITH u AS (SELECT p_partkey::DOUBLE AS k, p_size::DOUBLE AS s, p_retailprice AS v, p_type AS c FROM part),
  d AS (SELECT a.k, a.s, b.v, b.c, row_number() OVER (PARTITION BY a.k, a.s ORDER BY sqrt(((a.k - b.k) * (a.k - b.k) + (a.s - b.s) * (a.s - b.s)) * 2.0 / 2), b.k, b.s) AS rn FROM u a JOIN u b ON true),
  n AS (SELECT * FROM d WHERE rn <= 5)"""


@query(
    "m16_neighbours_regression",
    f"""{NEIGHBOURS} SELECT u.k AS p_partkey, u.s AS p_size, u.v AS label, round(p.prediction, 4) AS prediction FROM u JOIN (SELECT k, s, avg(v) AS prediction FROM n GROUP BY 1, 2) p USING (k, s)""",
)
def neighbours_number(t):
    found = training.neighbour_predict(t.part, t.part, ["p_partkey", "p_size"], "p_retailprice", "regression")
    return rounded(found, ["prediction"])


@query(
    "m16_neighbours_classification",
    f"""{NEIGHBOURS}, v AS (SELECT k, s, c, count(*) AS n, row_number() OVER (PARTITION BY k, s ORDER BY count(*) DESC, c) AS r FROM n GROUP BY 1, 2, 3)
    SELECT u.k AS p_partkey, u.s AS p_size, u.c AS label, v.c AS prediction FROM u JOIN v USING (k, s) WHERE r = 1""",
)
def neighbours_class(t):
    return training.neighbour_predict(t.part, t.part, ["p_partkey", "p_size"], "p_type", "classification")
