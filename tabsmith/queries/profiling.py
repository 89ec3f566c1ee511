"""Queries for profiles, quality and recommendations (F, A8, A9, A15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabsmith.operators import profile, quality
from tabsmith.operators.frequency import top_values
from tabsmith.queries.fixtures import (
    DATED_ORDERS,
    DIRTY_CUSTOMER,
    GAPPY_ORDERS,
    dated_orders,
    dirty_customer,
    gappy_orders,
)
from tabsmith.queries.registry import query


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


GAPPY_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_rare", "o_empty"]

F1_SQL = f"""
WITH g AS ({GAPPY_ORDERS})
SELECT * FROM ({union_sql([
    f"SELECT '{c}' AS column, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
    f"round_even((count(*) - count({c})) * 100.0 / count(*), 2) AS percent FROM g" for c in GAPPY_COLUMNS
])}) WHERE missing > 0
"""


@query("f1_missing_stats", F1_SQL.replace("AS column", 'AS "column"'))
def missing_stats(t):
    return profile.missing_stats(gappy_orders(t))


def stats_sql(source: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        if kind in ("integer", "float"):
            numbers = (
                f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, "
                f"round(stddev_samp({c}), 4) AS std, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, "
                f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75"
            )
        else:
            numbers = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in "min max mean std q25 median q75".split())
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) AS rows, count(*) - count({c}) AS nulls, "
            f"{numbers}, count(DISTINCT {c}) AS \"distinct\" FROM {source}"
        )
    return union_sql(parts)


LINE_TYPES = {
    "l_orderkey": "integer", "l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float",
    "l_discount": "float", "l_returnflag": "string", "l_shipdate": "datetime",
}
STATS = ["mean", "std", "q25", "median", "q75"]


@query("f2_column_stats", stats_sql("lineitem", LINE_TYPES))
def column_stats(t):
    return rounded(profile.column_stats(t.lineitem, list(LINE_TYPES)), STATS)


@query(
    "f3_top_values",
    """SELECT CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank, value, n AS count
       FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1) QUALIFY rank <= 10""",
)
def top(t):
    return top_values(t.part, "p_brand", 10)


GAPPY_TYPES = {
    "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "float",
    "o_orderdate": "datetime", "o_orderpriority": "string", "o_rare": "float", "o_empty": "string",
}


@query(
    "f4_profile",
    f"""WITH g AS ({GAPPY_ORDERS})
    SELECT *, round_even(nulls * 100.0 / rows, 2) AS missing_percent FROM ({stats_sql("g", GAPPY_TYPES)})""",
)
def full_profile(t):
    return rounded(profile.profile(gappy_orders(t)), STATS)


def extended_sql() -> str:
    parts = []
    for c, kind in {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "string"}.items():
        num = kind != "string"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS \"values\", "
            + (f"count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, " if num else "CAST(NULL AS BIGINT) AS zeros, CAST(NULL AS BIGINT) AS negatives, ")
            + ("count(*) FILTER (isinf(c_acctbal)) AS infinities, " if kind == "float" else "CAST(NULL AS BIGINT) AS infinities, ")
            + (f"round(quantile_cont(CAST({c} AS DOUBLE), 0.05), 4) AS q05, round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 4) AS q95, " if num else "CAST(NULL AS DOUBLE) AS q05, CAST(NULL AS DOUBLE) AS q95, ")
            + f"count(DISTINCT {c}) AS \"distinct\", round(count(DISTINCT {c}) * 1.0 / count({c}), 4) AS uniqueness, count(DISTINCT {c}) = count({c}) AS is_unique FROM customer"
        )
    return union_sql(parts)


@query("f5_profile_extended", extended_sql())
def extended(t):
    return rounded(profile.profile_extended(t.customer), ["q05", "q95", "uniqueness"])


def logical_sql() -> str:
    shape = r"\d{4}|\d{2}[-/]\d{2}|\d{2}[-/]\d{4}"
    parts = []
    for c in ["segment", "balance", "points", "name"]:
        f = f"nullif({c}, '')"
        parts.append(f"""SELECT '{c}' AS "column",
          round(coalesce(count(*) FILTER (lower({f}) IN ('true','false','yes','no','1','0')) * 1.0 / count({f}), 0), 4) AS boolean_share,
          0.0::DOUBLE AS datetime_share,
          round(coalesce(count(*) FILTER (regexp_matches(regexp_replace({f}, '[,$%]', '', 'g'), '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)')) * 1.0 / count({f}), 0), 4) AS numeric_share FROM d""")
    return f"""WITH d AS ({DIRTY_CUSTOMER})
      SELECT *, CASE WHEN boolean_share > 0.8 THEN 'boolean' WHEN datetime_share > 0.7 THEN 'datetime'
                     WHEN numeric_share > 0.8 THEN 'numeric' ELSE 'categorical' END AS logical_type
      FROM ({union_sql(parts)})"""


@query("f6_logical_types", logical_sql())
def logical(t):
    return profile.logical_type_shares(dirty_customer(t), ["segment", "balance", "points", "name"])


@query(
    "f7_quick_quality",
    f"""WITH g AS (SELECT o_orderstatus, o_totalprice, o_rare, o_empty, 'EUR' AS unit FROM ({GAPPY_ORDERS})),
    s AS (SELECT count(*) AS n, count(o_orderstatus) AS a, count(o_totalprice) AS b, count(o_rare) AS c FROM g),
    k AS (SELECT n, (a + b + c + n) * 100.0 / (5 * n) AS comp, (n - c) * 100.0 / n AS rare FROM s)
    SELECT 'completeness' AS kind, CAST(NULL AS VARCHAR) AS "column", round(comp, 1) AS value FROM k
    UNION ALL SELECT 'consistency', NULL, 100.0 FROM k
    UNION ALL SELECT 'low completeness', NULL, round(comp, 1) FROM k WHERE comp < 80
    UNION ALL SELECT 'mostly missing', 'o_rare', round(rare, 1) FROM k WHERE rare > 50
    UNION ALL SELECT 'mostly missing', 'o_empty', 100.0 FROM k
    UNION ALL SELECT 'single value', 'unit', 1.0 FROM k""",
)
def quick(t):
    return profile.quick_quality(
        gappy_orders(t).select("o_orderstatus", "o_totalprice", "o_rare", "o_empty", F.lit("EUR").alias("unit"))
    )


QUALITY_PARTS = f"""
WITH g AS ({GAPPY_ORDERS}),
n AS (SELECT count(*) AS rows, count(*) * 8 AS cells,
             count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate)
             + count(o_orderpriority) + count(o_rare) + count(o_empty) AS filled,
             count(DISTINCT o_orderstatus) AS d_status, count(DISTINCT o_orderpriority) AS d_priority,
             count(DISTINCT o_orderdate) AS d_date FROM g),
r AS (SELECT rows, (cells - filled) * 1.0 / cells AS miss FROM n),
q AS (SELECT quantile_cont(o_orderkey::DOUBLE, 0.25) AS a1, quantile_cont(o_orderkey::DOUBLE, 0.75) AS b1,
             quantile_cont(o_custkey::DOUBLE, 0.25) AS a2, quantile_cont(o_custkey::DOUBLE, 0.75) AS b2,
             quantile_cont(o_totalprice, 0.25) AS a3, quantile_cont(o_totalprice, 0.75) AS b3,
             quantile_cont(o_rare, 0.25) AS a4, quantile_cont(o_rare, 0.75) AS b4 FROM g),
o AS (SELECT count(*) FILTER (o_orderkey < a1 - 3 * (b1 - a1) OR o_orderkey > b1 + 3 * (b1 - a1)) * 1.0 / count(*) AS r1,
             count(*) FILTER (o_custkey < a2 - 3 * (b2 - a2) OR o_custkey > b2 + 3 * (b2 - a2)) * 1.0 / count(*) AS r2,
             count(*) FILTER (o_totalprice < a3 - 3 * (b3 - a3) OR o_totalprice > b3 + 3 * (b3 - a3)) * 1.0 / count(*) AS r3,
             count(*) FILTER (o_rare < a4 - 3 * (b4 - a4) OR o_rare > b4 + 3 * (b4 - a4)) * 1.0 / count(*) AS r4 FROM g, q),
s AS (SELECT max(c) * 1.0 / any_value(rows) AS top FROM (SELECT o_orderstatus, count(*) AS c FROM g WHERE o_orderstatus IS NOT NULL GROUP BY 1), n),
p AS (SELECT max(c) * 1.0 / any_value(rows) AS top FROM (SELECT o_orderpriority, count(*) AS c FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1), n),
c AS (
  SELECT 'completeness' AS component, CASE WHEN miss = 0 THEN 100.0 WHEN miss < 0.05 THEN 95.0 WHEN miss < 0.1 THEN 85.0
     WHEN miss < 0.2 THEN 70.0 WHEN miss < 0.3 THEN 50.0 ELSE greatest(20.0, 100 - 200 * miss) END::DOUBLE AS score FROM r
  UNION ALL SELECT 'size', 0.7 * least(100.0, rows / 10.0) + 30.0 FROM r
  UNION ALL SELECT 'validity', (400.0 + CASE WHEN r1 > 0.1 THEN 70 ELSE 100 END + CASE WHEN r2 > 0.1 THEN 70 ELSE 100 END
     + CASE WHEN r3 > 0.1 THEN 70 ELSE 100 END + CASE WHEN r4 > 0.1 THEN 70 ELSE 100 END) / 8 FROM o
  UNION ALL SELECT 'feature_quality', (700.0 + 100.0) / 8 FROM r
  UNION ALL SELECT 'balance', ((CASE WHEN s.top < 0.6 THEN 100 WHEN s.top < 0.8 THEN 70 ELSE 40 END)
     + (CASE WHEN p.top < 0.6 THEN 100 WHEN p.top < 0.8 THEN 70 ELSE 40 END)) / 2.0 FROM s, p)
"""


@query("f8_quality_components", QUALITY_PARTS + "SELECT component, round(score::DOUBLE, 4) AS score FROM c")
def components(t):
    return rounded(quality.quality_components(gappy_orders(t)), ["score"])


@query(
    "f8_quality_score",
    QUALITY_PARTS
    + """SELECT score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair' ELSE 'Poor' END AS rating
    FROM (SELECT round_even(sum(score::DOUBLE * CASE component WHEN 'completeness' THEN 0.30 WHEN 'size' THEN 0.20 WHEN 'feature_quality' THEN 0.25
          WHEN 'validity' THEN 0.15 ELSE 0.10 END), 2)::DOUBLE AS score FROM c)""",
)
def score(t):
    return quality.quality_score(gappy_orders(t))


NAMES = ["customer", "orders", "part", "supplier", "events", "documents"]


def catalogue(t) -> DataFrame:
    frames = [
        quality.characteristics(getattr(t, n)).withColumn("dataset", F.lit(n))
        for n in NAMES
    ]
    return reduce(DataFrame.unionByName, frames)


CATALOGUE = """
SELECT 'customer' AS dataset, round_even(3 / 5.0, 3)::DOUBLE AS numeric_ratio, round_even(2 / 5.0, 3)::DOUBLE AS categorical_ratio, 0.0::DOUBLE AS missing_ratio, 5 AS feature_count, count(*) AS sample_count, 3 AS numeric_features, 2 AS categorical_features,
  (CASE WHEN count(DISTINCT c_mktsegment) BETWEEN 2 AND 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT c_name) BETWEEN 2 AND 20 THEN 1 ELSE 0 END) AS classification_targets,
  (CASE WHEN count(DISTINCT c_custkey) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT c_nationkey) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT c_acctbal) > 20 THEN 1 ELSE 0 END) AS regression_targets,
  false AS series_candidate, false AS has_text FROM customer
UNION ALL
SELECT 'supplier', 0.75, 0.25, 0.0, 4, count(*), 3, 1,
  CASE WHEN count(DISTINCT s_name) BETWEEN 2 AND 20 THEN 1 ELSE 0 END,
  CASE WHEN count(DISTINCT s_suppkey) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT s_nationkey) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT s_acctbal) > 20 THEN 1 ELSE 0 END,
  false, false FROM supplier
UNION ALL
SELECT 'orders', 0.5, 0.333, 0.0, 6, count(*), 3, 2,
  CASE WHEN count(DISTINCT o_orderstatus) BETWEEN 2 AND 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT o_orderpriority) BETWEEN 2 AND 20 THEN 1 ELSE 0 END,
  CASE WHEN count(DISTINCT o_orderkey) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT o_custkey) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT o_totalprice) > 20 THEN 1 ELSE 0 END,
  true, false FROM orders
UNION ALL
SELECT 'part', 0.5, 0.5, 0.0, 6, count(*), 3, 3,
  CASE WHEN count(DISTINCT p_name) BETWEEN 2 AND 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT p_brand) BETWEEN 2 AND 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT p_type) BETWEEN 2 AND 20 THEN 1 ELSE 0 END,
  CASE WHEN count(DISTINCT p_partkey) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT p_size) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT p_retailprice) > 20 THEN 1 ELSE 0 END,
  false, false FROM part
UNION ALL
SELECT 'events', 0.5, 0.333, 0.0, 6, count(*), 3, 2,
  CASE WHEN count(DISTINCT event_type) BETWEEN 2 AND 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT props) BETWEEN 2 AND 20 THEN 1 ELSE 0 END,
  CASE WHEN count(DISTINCT event_id) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT user_id) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT value) > 20 THEN 1 ELSE 0 END,
  true, false FROM events
UNION ALL
SELECT 'documents', 0.4, 0.6, 0.0, 5, count(*), 2, 3,
  CASE WHEN count(DISTINCT text) BETWEEN 2 AND 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT lang) BETWEEN 2 AND 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT source) BETWEEN 2 AND 20 THEN 1 ELSE 0 END,
  CASE WHEN count(DISTINCT doc_id) > 20 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT n_chars) > 20 THEN 1 ELSE 0 END,
  false, avg(length(text)) > 100 FROM documents
"""


@query(
    "f9_characteristics",
    f"SELECT dataset, numeric_ratio, categorical_ratio, missing_ratio, feature_count, sample_count, numeric_features, categorical_features, classification_targets, regression_targets, series_candidate, has_text FROM ({CATALOGUE})",
)
def described(t):
    return catalogue(t).drop("potential_targets", "high_cardinality")


# The rules of the SQL, written down apart from those of the library: task, place, model, smallest
# sample, wants numbers, size class, other points.
MODEL_RULES = """
  ('classification', 0, 'Logistic Regression', 100, true, 'small', 0),
  ('classification', 1, 'Random Forest', 200, false, 'medium', 10),
  ('classification', 2, 'XGBoost', 500, false, 'large', 20),
  ('classification', 3, 'Gradient Boosting', 300, false, 'medium', 20),
  ('classification', 4, 'Decision Tree', 50, false, 'small', 10),
  ('classification', 5, 'SVM', 100, true, 'small', 0),
  ('classification', 6, 'K-Nearest Neighbors', 100, true, 'small', 0),
  ('classification', 7, 'Naive Bayes', 50, false, 'small', 0),
  ('classification', 8, 'Neural Network', 1000, false, 'large', 0),
  ('regression', 0, 'Linear Regression', 100, true, 'small', 0),
  ('regression', 1, 'Random Forest', 200, false, 'medium', 10),
  ('regression', 2, 'XGBoost', 500, false, 'large', 20),
  ('regression', 3, 'Gradient Boosting', 300, false, 'medium', 0),
  ('regression', 4, 'Decision Tree', 50, false, 'small', 0),
  ('regression', 5, 'SVR', 100, true, 'small', 0),
  ('regression', 6, 'Ridge/Lasso', 100, true, 'small', 0)
"""


@query(
    "f10_recommend_models",
    f"""WITH c AS ({CATALOGUE}),
    rules(task, place, model, smallest, numeric_heavy, size, bonus) AS (VALUES {MODEL_RULES}),
    k AS (SELECT dataset, sample_count AS n, numeric_ratio AS r,
                 CASE WHEN series_candidate THEN 'time_series' WHEN classification_targets > 0 AND classification_targets >= regression_targets THEN 'classification' ELSE 'regression' END AS task FROM c),
    s AS (
      SELECT dataset, task, place, model,
        least(100.0, CASE WHEN n >= smallest THEN 20.0 ELSE n * 20.0 / smallest END
              + CASE WHEN numeric_heavy AND r > 0.5 THEN 15 ELSE 0 END
              + CASE WHEN size = CASE WHEN n < 300 THEN 'small' WHEN n < 1000 THEN 'medium' ELSE 'large' END THEN 25 ELSE 0 END
              + bonus) AS score
      FROM k JOIN rules USING (task)
      UNION ALL
      SELECT dataset, task, place, model, CASE WHEN n > want THEN hi ELSE lo END FROM k,
        (VALUES (0, 'Prophet', 100, 95, 70), (1, 'ARIMA', 50, 90, 60), (2, 'XGBoost', 300, 85, 50), (3, 'LSTM', 1000, 80, 40), (4, 'Linear Regression', 0, 70, 70)) AS v(place, model, want, hi, lo)
      WHERE task = 'time_series')
    SELECT dataset, task, CAST(row_number() OVER (PARTITION BY dataset ORDER BY score DESC, place) AS INTEGER) AS rank, model, round(score::DOUBLE, 4) AS score
    FROM s QUALIFY rank <= 5""",
)
def recommended(t):
    return quality.recommend_models(catalogue(t), "auto", 5)


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "f11_correlation_matrix",
    union_sql(
        [
            f"SELECT '{a}' AS x, '{b}' AS y, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 4)") + " AS r FROM "
            + ("(SELECT 1)" if a == b else "lineitem")
            for a in CORR
            for b in CORR
        ]
    ),
)
def correlations(t):
    return rounded(profile.correlation_matrix(t.lineitem, CORR), ["r"])


@query(
    "f12_value_balance",
    "SELECT l_returnflag AS label, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2)::DOUBLE AS percent FROM lineitem GROUP BY 1",
)
def balance(t):
    return profile.value_balance(t.lineitem, "l_returnflag")


@query(
    "a8_validate_source",
    "SELECT count(*) AS rows, 6 AS columns, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS names, count(*) > 0 AS valid FROM orders",
)
def validated(t):
    return profile.validate_source(t.orders)


@query(
    "a9_infer_types",
    f"""WITH d AS ({DATED_ORDERS}),
    v AS (SELECT o_orderkey, unnest([{{'c': 'iso_date', 'v': iso_date}}, {{'c': 'euro', 'v': euro}}, {{'c': 'remark', 'v': remark}},
            {{'c': 'epoch', 'v': epoch::VARCHAR}}, {{'c': 'o_orderpriority', 'v': o_orderpriority}}]) AS p FROM d),
    s AS (SELECT p.c AS c, p.v AS v, row_number() OVER (PARTITION BY p.c ORDER BY o_orderkey) AS rn FROM v)
    SELECT c AS "column", count(*) AS "values",
      CASE c WHEN 'iso_date' THEN 'datetime' WHEN 'euro' THEN 'datetime' WHEN 'epoch' THEN 'integer' ELSE 'string' END AS type,
      string_agg(v, '|' ORDER BY rn) FILTER (rn <= 5) AS samples
    FROM s GROUP BY c""",
)
def inferred(t):
    source = dated_orders(t).select("o_orderkey", "iso_date", "euro", "remark", F.col("epoch").cast("string").alias("epoch"), "o_orderpriority")
    return profile.infer_types(source, "o_orderkey")
