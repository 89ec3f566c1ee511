"""Hand-made frames for rules and edge cases."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsmith.functions.stats import skew_g1
from tabsmith.operators import clean, dates, features, impute, isolation, profile, quality
from tabsmith.operators.frequency import categories, modes, top_values
from tabsmith.plans.auto_clean import auto_clean
from tabsmith.plans.auto_features import auto_features
from tabsmith.plans.params import apply_params


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.fixture(scope="module")
def unit(spark):
    rows = [(i + 1, c, dt.datetime(2023, 1, i + 1), s) for i, (c, s) in enumerate(zip("ABACB", [1, 1, 1, 1, 100]))]
    return spark.createDataFrame(rows, "numeric_col bigint, category_col string, date_col timestamp, skewed_col bigint")


def test_auto_features_of_unit_frame(unit):
    out, report = auto_features(unit)
    assert set(unit.columns) <= set(out.columns)
    assert {"date_col_year", "date_col_month", "skewed_col_log", "category_col_B", "category_col_C"} <= set(out.columns)
    assert "category_col_A" not in out.columns and report["dates"] == ["date_col"]


def test_modes_take_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), ("b", 9), ("a", 10), (None, None)], "s string, n int")
    assert modes(df, ["s", "n"]) == {"s": "a", "n": "9"}
    assert modes(df.filter("s is null"), ["s"]) == {"s": None}


def test_sparse_limit_is_strict(spark):
    df = spark.createDataFrame([(i, 1 if i < 5 else None, 1 if i < 4 else None) for i in range(100)], "i int, at95 int, at96 int")
    assert clean.sparse_columns(df) == ["at96"]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "x", None, 1), (1, None, None, 2)], "a int, b string, c double, d int")
    assert clean.constant_columns(df) == ["a", "b", "c"]


def test_null_tokens_are_exact(spark):
    df = spark.createDataFrame([(v,) for v in ["N/A", "n/A", "Unknown", "####", " x", ""]], "v string")
    assert column(clean.null_tokens(df), "v") == [None, "n/A", "Unknown", None, " x", None]
    assert column(clean.null_tokens(df, clean.SERIES_NULL_TOKENS), "v")[2] is None


def test_duplicate_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"]).toDF("a", "a", "b")
    assert [tuple(r) for r in clean.drop_duplicate_columns(df).collect()] == [(1, 3)]
    with pytest.raises(ValueError):
        clean.require_unique_columns(df)


def test_awkward_names(spark):
    df = spark.createDataFrame([(1.0, None, "x"), (2.0, 3.0, None)], "`a.b (#)` double, `c d` double, `e/f` string")
    assert clean.inf_to_null_fill(df).count() == 2
    assert profile.profile(df).count() == 3
    assert auto_clean(df, numeric="median").frame.count() == 2


def test_conversions(spark):
    df = spark.createDataFrame([("1", "1.5", "x"), ("2", "2", None)], "a string, b string, c string")
    out = clean.convert_types(df, {"a": "int", "b": "int", "c": "int", "zzz": "int"})
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "double", "bigint"]
    assert [tuple(r) for r in out.collect()] == [(1, 1.5, None), (2, 2.0, None)]


def test_infinities(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (4.0,), (7.0,)], "v double")
    assert sorted(column(clean.inf_to_null_fill(df), "v")) == [1.0, 4.0, 4.0, 4.0, 7.0]


def test_skewness(spark):
    import numpy as np

    values = [1.0, 1.0, 2.0, 9.0, 30.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert math.isclose(df.agg(skew_g1(F.col("v")).alias("g")).first()["g"], pd.Series(values).skew(), rel_tol=1e-9)
    assert df.limit(2).agg(skew_g1(F.col("v")).alias("g")).first()["g"] is None
    assert np.isclose(df.select(F.lit(3.0).alias("v")).agg(skew_g1(F.col("v")).alias("g")).first()["g"], 0)


DATES = {
    "2023-01-05": "2023-01-05",
    "2023-1-5": "2023-01-05",
    "01/02/2023": "2023-01-02",
    "13/02/2023": "2023-02-13",
    "2023/01/02": "2023-01-02",
    "02-03-2023": "2023-02-03",
    "25-03-2023": "2023-03-25",
    "2023.01.02": "2023-01-02",
    "05.06.2023": "2023-06-05",
    "2023-01-05 10:20:30": "2023-01-05 10:20:30",
    "01/02/2023 1:02:03": "2023-01-02 01:02:03",
    "2023-01-05T10:20:30": "2023-01-05 10:20:30",
    "2023-01-05 10:20:30.5": "2023-01-05 10:20:30.500000",
    "Jan 5, 2023": "2023-01-05",
    "January 5, 2023": "2023-01-05",
    "5 Mar 2023": "2023-03-05",
    "5 March 2023": "2023-03-05",
    "01/02/99": "1999-01-02",
    "13/02/68": "2068-02-13",
    "99/12/31": "1999-12-31",
    "05-Dec-2023": "2023-12-05",
    "20230105": "2023-01-05",
    "2023-02-30": None,
    "31/31/2023": None,
    "2023": None,
    "4-NOT SPECIFIED": None,
    "Janus 5, 2023": None,
    "": None,
    "20231301": None,
}


def test_listed_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "v string")
    got = df.select("v", dates.flexible_timestamp(F.col("v")).alias("t")).collect()
    for r in got:
        assert (str(r["t"]) if r["t"] else None) == (
            None if DATES[r["v"]] is None else str(pd.Timestamp(DATES[r["v"]]).to_pydatetime())
        ), r["v"]


def test_fast_reading_equals_listed_formats(spark):
    """The shape rewriting reads what the listed formats read one by one."""
    from tabsmith.functions.date_rules import DATE_FORMATS

    df = spark.createDataFrame([(k,) for k in DATES], "v string")
    slow = F.coalesce(*[dates.by_format(F.col("v"), p, s) for p, _, s in DATE_FORMATS])
    both = df.select("v", slow.alias("slow"), dates.readings(F.col("v")).alias("fast"))
    assert both.filter(~F.col("slow").eqNullSafe(F.col("fast"))).collect() == []


def test_day_first_choice(spark):
    days = spark.createDataFrame([("13/01/2023",), ("02/03/2023",), ("x",)], "d string")
    assert column(dates.smart_parse(days, "d"), "d")[1] == dt.datetime(2023, 3, 2)
    months = spark.createDataFrame([("01/13/2023",), ("02/03/2023",)], "d string")
    assert column(dates.smart_parse(months, "d"), "d")[1] == dt.datetime(2023, 2, 3)
    words = spark.createDataFrame([("a",), ("b",), ("01/01/2023",)], "d string")
    assert dates.smart_parse(words, "d").schema["d"].dataType.simpleString() == "string"


def test_date_name_without_content(spark):
    df = spark.createDataFrame([("soon", "2023-01-01 and more")], "date string, created string")
    assert dates.detect_date_columns(df) == ["created"]
    found = {r["column"]: r["reason"] for r in dates.detect_date_columns_ts(df).collect()}
    assert found["date"] == "exact name"


def test_quantile_bins_like_pandas(spark):
    values = [0.0, 0.0, 0.0, 1.0, 2.0, 2.0, 3.5, 8.0, 9.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    s = pd.Series(values, dtype=float)
    for q in (2, 4, 5):
        want = pd.qcut(s, q, labels=False, duplicates="drop")
        got = features.quantile_bin(df, "v", q, "codes").orderBy("i").toPandas()["v_binned"]
        assert [None if x != x else int(x) for x in got] == [None if x != x else int(x) for x in want]
        text = pd.qcut(s, q, duplicates="drop").astype(object)
        named = column(features.quantile_bin(df, "v", q).orderBy("i"), "v_binned")
        assert named == [None if x != x else str(x) for x in text]
    assert features.quantile_bin(df, "v", 4, ["only", "two"]) is df


def test_one_hot_like_pandas(spark):
    values = ["b", "a", None, "c d"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for first in (True, False):
        want = pd.get_dummies(pd.Series(values), prefix="v", drop_first=first)
        got = features.one_hot(df, ["v"], first).orderBy("i").drop("i", "v").toPandas()
        assert list(got.columns) == list(want.columns) and (got.to_numpy() == want.to_numpy()).all()


def test_categories_bound(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("few"), F.col("id").cast("string").alias("many"))
    assert categories(df, ["few", "many"], 10) == {"few": ["0", "1", "2"]}


def test_top_values_ties(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "a", "c", None]], "v string")
    assert [(r["rank"], r["value"], r["count"]) for r in top_values(df, "v", 2).collect()] == [(1, "a", 2), (2, "b", 2)]


def test_serving_single_row_equals_training(spark):
    rows = [(i, f"c{i % 3}" if i % 7 else None, float(i * i) if i % 5 else None, f"2023-0{1 + i % 9}-11") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, kind string, amount double, order_date string")
    done = auto_clean(df, numeric="median")
    assert "kind_c1" in done.frame.columns and "order_date_year" not in done.frame.columns  # one year only
    whole = {r["id"]: r for r in done.frame.collect()}
    for i in (0, 5, 7, 35):
        one = apply_params(df.filter(F.col("id") == i), done.params).first()
        assert one == whole[i]
    unseen = spark.createDataFrame([(99, "new", None, "2023-05-05")], df.schema)
    served = apply_params(unseen, done.params).first()
    assert served["kind"] == "new" and not any(served[c] for c in done.frame.columns if c.startswith("kind_"))


def test_user_column_with_engineered_suffix(spark):
    df = spark.createDataFrame([(i, None if i == 3 else 1900.0 + i) for i in range(30)], "i int, model_year double")
    done = auto_clean(df, numeric="median")
    assert done.frame.filter("model_year is null").count() == 0 and done.params["fill"]["model_year"] == 1915.0


def test_knn_clean_freezes_medians(spark):
    df = spark.createDataFrame([(float(i), None if i == 4 else float(i * 10)) for i in range(30)], "a double, b double")
    done = auto_clean(df)
    assert done.params["fill"] == {"b": 150.0}
    near = {r["a"]: r["b"] for r in done.frame.collect()}[4.0]
    assert near == (10 + 20 + 30 + 50 + 60) / 5  # 2, 3, 5, 6 and the smaller of 1 and 7


def test_target_encoding_smooths(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), (None, 2.0)], "k string, y double")
    got = dict(features.target_encode(df, ["k"], "y", smoothing=2.0).select("k", "k_target").collect())
    assert got == {"a": (4 + 2 * 4) / 4, "b": (10 + 2 * 4) / 3, None: 4.0}


def plain_path(tree, row, at=0):
    while tree.feature[at] >= 0:
        at = tree.low[at] if row[tree.feature[at]] < tree.cut[at] else tree.high[at]
    return tree.length[at]


def test_isolation_forest_against_a_plain_walk(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2) if i % 9 else None, "x") for i in range(400)] + [(900 + i, 0.5, 5.0, "x") for i in range(200)]
    rows += [(2000, 40.0, 5.0, "x"), (2001, 0.0, -90.0, "x"), (2002, float("nan"), None, None), (2003, None, float("inf"), "x")]
    df = spark.createDataFrame(rows, "id int, `a b` double, b double, _x string")
    names = ["a b", "b"]
    forest = isolation.fit_forest(df.repartition(7), names)
    assert isolation.fit_forest(df.repartition(2), names) == forest and len(forest.trees) == 100
    for tree in forest.trees:
        leaves = [i for i, f in enumerate(tree.feature) if f < 0]
        assert len(leaves) * 2 - 1 == len(tree.feature) and max(tree.length) <= 8 + isolation.usual_path(256)
    got = {r["id"]: r["s"] for r in df.select("id", isolation.isolation_score(forest).alias("s")).collect()}
    for i, a, b, _ in rows:
        row = [v if v is not None and math.isfinite(v) else m for v, m in zip((a, b), forest.fill)]
        want = 2 ** -(sum(plain_path(t, row) for t in forest.trees) / 100 / isolation.usual_path(256))
        assert math.isclose(got[i], want, rel_tol=1e-12)
    assert sorted(got, key=got.get)[-2:] in ([2000, 2001], [2001, 2000]) and got[900] < 0.5
    kept = isolation.trim_isolated_rows(df, names, 0.05)
    assert kept.columns == df.columns and not kept.filter("id in (2000, 2001)").count() and abs(kept.count() - 604 * 0.95) <= 2


def test_isolation_of_nothing_and_of_copies(spark):
    none = spark.createDataFrame([], "a double")
    assert isolation.trim_isolated_rows(none, ["a"]).collect() == []
    same = spark.createDataFrame([(1.0,)] * 50 + [(None,)] * 3, "a double")
    assert isolation.trim_isolated_rows(same, ["a"]).count() == 53


def test_power_transform_lowers_skew(spark):
    df = spark.range(1, 400).select((F.col("id") ** 3).cast("double").alias("v"))
    lam = features.power_lambdas(df, ["v"])["v"]
    assert 0.2 < lam < 0.5
    assert abs(features.power_transform(df, ["v"]).agg(skew_g1(F.col("v"))).first()[0]) < 0.4


def test_pca_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).reset_index(names="i"))
    got = features.pca(df, ["a", "b", "c"], 2).orderBy("i").toPandas()[["pc1", "pc2"]].to_numpy()
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    signed = [v if v[np.abs(v).argmax()] > 0 else -v for v in vt[:2]]
    np.testing.assert_allclose(got, (x - x.mean(0)) @ np.array(signed).T, atol=1e-8)
    gaps = df.withColumn("b", F.when(F.col("i") % 10 > 0, F.col("b")))
    got = features.pca(gaps, ["a", "b", "c"], 3).orderBy("i").toPandas()
    whole = x[np.arange(200) % 10 > 0]
    values, axes = np.linalg.eigh(np.cov(whole.T))
    want = [axes[:, j] * np.sign(axes[np.abs(axes[:, j]).argmax(), j]) for j in (2, 1, 0)]
    np.testing.assert_allclose(got.dropna()[["pc1", "pc2", "pc3"]].to_numpy(), (whole - whole.mean(0)) @ np.array(want).T, atol=1e-8)
    assert got["pc1"].isna().sum() == 20
    with pytest.raises(ValueError):
        features.pca(df, ["a"], 2)


def test_completeness_score(spark):
    ratios = [0.0, 0.01, 0.07, 0.15, 0.25, 0.35, 0.9]
    df = spark.createDataFrame([(r,) for r in ratios], "r double")
    assert [round(x, 6) for x in column(df.select(quality.completeness_score(F.col("r")).alias("s")), "s")] == [100, 95, 85, 70, 50, 30, 20]


def test_series_candidate_needs_parsed_values(spark):
    plain = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    assert not quality.is_series_candidate(plain)
    assert quality.is_series_candidate(plain.withColumn("w", F.lit("2023-01-01")))


def test_time_scores_use_input_order(spark):
    rows = [(i, dt.datetime(2023, 1, 1 + i), dt.datetime(2023, 1, 28 - i), 5 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, up timestamp, down timestamp, n int")
    got = {r["column"]: r["score"] for r in dates.score_time_columns(df, "i").collect()}
    assert got == {"up": 65, "down": 50}


def test_impute_unknown_mode(spark):
    df = spark.createDataFrame([(None, None)], "s string, v double")
    assert tuple(impute.impute_mode(df, ["s"]).first()) == ("Unknown", None)
    assert impute.impute_mean(df, ["v"]).first()["v"] == 0.0
    assert impute.impute_median(df, ["v"]).first()["v"] == 0.0


def test_first_values_of_all_columns_in_one_scan(spark):
    rows = [(i * 7 % 1000, None if i % 3 else f"t{i}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i) if i > 990 else None, None) for i in range(1000)]
    rows += [(None, "no key", None, None, None), (None, None, dt.datetime(1999, 1, 1), None, None)]
    kinds = "k int, `a b` string, ts timestamp, few double, none string"
    df = spark.createDataFrame(rows, kinds).repartition(9)
    names = ["a b", "ts", "few", "none", "k"]
    got = {r["column"]: r["samples"] for r in profile.first_values(df, names, "k", 4).collect()}
    for i, name in ((1, "a b"), (2, "ts"), (3, "few"), (0, "k")):
        known = sorted((r[0] is not None, r[0] or 0, str(r[i])) for r in rows if r[i] is not None)[:4]
        assert got[name] == "|".join(v for _, _, v in known), name
    assert "none" not in got and profile.first_values(df.limit(0), names, "k", 4).collect() == []
