"""Queries for feature engineering and automatic flows (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabsmith.operators import features
from tabsmith.plans.auto_clean import auto_clean
from tabsmith.plans.auto_features import auto_features
from tabsmith.plans.params import apply_params, load_params, save_params
from tabsmith.queries.fixtures import GAPPY_DAILY, GAPPY_ORDERS, gappy_daily, gappy_orders
from tabsmith.queries.imputation import mode_of
from tabsmith.queries.profiling import rounded
from tabsmith.queries.registry import query
from tabsmith.session import scratch_path


def four(df: DataFrame) -> DataFrame:
    """Every fractional column to four decimals."""
    return rounded(df, [f.name for f in df.schema if f.dataType.simpleString() == "double"])


def skewed(t):
    return t.events.select(
        "event_id",
        F.col("value").alias("v"),
        (F.col("value") * F.col("value") + 0.01).alias("square"),
        (F.col("event_id") % 2).alias("flag"),
    )


G1 = lambda c: f"(SELECT skewness({c}) FROM e)"


@query(
    "e1_auto_skew_features",
    f"""WITH e AS (SELECT event_id, value AS v, value * value + 0.01 AS square, event_id % 2 AS flag FROM events)
    SELECT event_id, round(v, 4) AS v, round(square, 4) AS square, flag,
      round(CASE WHEN {G1("v")} > 1 AND {G1("v")} <= 2 AND (SELECT min(v) FROM e) >= 0 THEN sqrt(v) END, 4) AS v_sqrt,
      round(CASE WHEN {G1("square")} > 2 AND (SELECT min(square) FROM e) > 0 THEN ln(1 + square) END, 4) AS square_log,
      round(CASE WHEN {G1("square")} > 1 THEN sqrt(square) END, 4) AS square_sqrt FROM e""",
)
def skew(t):
    return four(features.auto_skew_features(skewed(t)))


@query(
    "e2_auto_transform",
    """WITH p AS (SELECT skewness(value) FILTER (value > 0) AS g FROM events)
    SELECT event_id, value, round(CASE WHEN abs(g) > 1 THEN ln(1 + greatest(value, 0)) END, 4) AS value_log, round(sqrt(greatest(value, 0)), 4) AS value_sqrt,
      round(CASE WHEN value <> 0 THEN 1 / value END, 4) AS value_reciprocal FROM events, p""",
)
def auto(t):
    return four(features.auto_transform(t.events.select("event_id", "value"), exclude=["event_id"]))


@query(
    "e3_numeric_transforms",
    """SELECT c_custkey, c_acctbal, round(ln(1 + greatest(c_acctbal, 0)), 4) AS c_acctbal_log, round(sqrt(greatest(c_acctbal, 0)), 4) AS c_acctbal_sqrt,
      round(c_acctbal * c_acctbal, 2) AS c_acctbal_squared, round(CASE WHEN c_acctbal <> 0 THEN 1 / c_acctbal END, 4) AS c_acctbal_reciprocal FROM customer""",
)
def transforms(t):
    out = t.customer.select("c_custkey", "c_acctbal")
    for kind in ("log", "sqrt", "squared", "reciprocal"):
        out = features.transform(out, kind, ["c_acctbal"])
    return rounded(four(out.drop("c_acctbal_squared")).join(out.select("c_custkey", "c_acctbal_squared"), "c_custkey"), ["c_acctbal_squared"], 2)


def codes_sql(table: str, c: str, q: int) -> str:
    """Codes over distinct edges, so repeated edges make fewer bins."""
    probs = ", ".join(str(i / q) for i in range(q + 1))
    return f"""(WITH e AS (SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{probs}]))) AS e FROM {table})
      SELECT k.*, CAST(CASE WHEN {c} IS NOT NULL THEN len(list_filter(e[2:len(e) - 1], lambda x: x < {c})) END AS INTEGER) AS {c}_binned FROM {table} k, e)"""


@query("e4_quantile_codes", f"SELECT l_orderkey, l_linenumber, l_quantity, l_quantity_binned FROM {codes_sql('lineitem', 'l_quantity', 4)}")
def codes(t):
    return features.quantile_bin(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 4, "codes")


@query(
    "e4_quantile_labels",
    f"""WITH g AS ({GAPPY_ORDERS})
    SELECT o_orderkey, o_totalprice, CASE o_totalprice_binned WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'high' END AS o_totalprice_binned
    FROM {codes_sql('g', 'o_totalprice', 3)}""",
)
def labels(t):
    g = gappy_orders(t).select("o_orderkey", "o_totalprice")
    return features.quantile_bin(g, "o_totalprice", 3, ["low", "mid", "high"])


@query(
    "e4_quantile_intervals",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, l_quantity_binned AS k FROM {codes_sql('lineitem', 'l_quantity', 5)}),
    q AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_quantity, '(' || CAST(CASE WHEN k = 0 THEN round(q[1] - 0.001, 3) ELSE q[k + 1] END AS VARCHAR) || ', ' || CAST(q[k + 2] AS VARCHAR) || ']' AS l_quantity_binned FROM b, q""",
)
def intervals(t):
    return features.quantile_bin(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 5)


MANY = 130


@query(
    "e5_one_hot_many",
    "SELECT o_orderkey, o_custkey % 130 AS slot, " + ", ".join(f'o_custkey % 130 = {v} AS "slot_{v}"' for v in range(MANY)) + " FROM orders",
)
def one_hot_many(t):
    """More values than any default bound: each still gets its column."""
    slots = t.orders.select("o_orderkey", (F.col("o_custkey") % MANY).alias("slot"))
    return features.one_hot(slots, ["slot"])


@query(
    "e5_one_hot",
    """SELECT l_orderkey, l_returnflag, coalesce(l_returnflag = 'A', false) AS "l_returnflag_A", coalesce(l_returnflag = 'N', false) AS "l_returnflag_N",
       coalesce(l_returnflag = 'R', false) AS "l_returnflag_R" FROM (SELECT l_orderkey, CASE WHEN l_orderkey % 9 <> 0 THEN l_returnflag END AS l_returnflag FROM lineitem)""",
)
def one_hot(t):
    flag = F.when(F.col("l_orderkey") % 9 != 0, F.col("l_returnflag")).alias("l_returnflag")
    return features.one_hot(t.lineitem.select("l_orderkey", flag), ["l_returnflag"])


@query(
    "e6_label_encode",
    f"""WITH g AS (SELECT o_orderkey, coalesce(o_orderstatus, 'missing') AS a, coalesce(o_orderpriority, 'missing') AS b FROM ({GAPPY_ORDERS}))
    SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY a) - 1 AS INTEGER) AS o_orderstatus, CAST(dense_rank() OVER (ORDER BY b) - 1 AS INTEGER) AS o_orderpriority FROM g""",
)
def label(t):
    g = gappy_orders(t).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return features.label_encode(g, ["o_orderstatus", "o_orderpriority"])


@query(
    "e7_target_encode",
    f"""WITH g AS ({GAPPY_ORDERS}), o AS (SELECT avg(o_totalprice) AS m FROM g),
    k AS (SELECT o_orderpriority, (sum(o_totalprice) + 10 * any_value(m)) / (count(o_totalprice) + 10) AS v FROM g, o WHERE o_orderpriority IS NOT NULL GROUP BY 1)
    SELECT g.o_orderkey, g.o_orderpriority, round(coalesce(v, m), 4) AS o_orderpriority_target FROM g CROSS JOIN o LEFT JOIN k USING (o_orderpriority)""",
)
def target(t):
    g = gappy_orders(t)
    encoded = features.target_encode(g, ["o_orderpriority"], "o_totalprice", smoothing=10.0)
    return rounded(encoded.select("o_orderkey", "o_orderpriority", "o_orderpriority_target"), ["o_orderpriority_target"])


SCALE = {
    "standard": "(value - avg(value) OVER ()) / stddev_pop(value) OVER ()",
    "minmax": "(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())",
    "robust": "(value - quantile_cont(value, 0.5) OVER ()) / (quantile_cont(value, 0.75) OVER () - quantile_cont(value, 0.25) OVER ())",
}
for _how, _sql in SCALE.items():

    @query(
        f"e8_scale_{_how}",
        f"SELECT event_id, round({_sql}, 4) AS value FROM events",
    )
    def scaled(t, how=_how):
        return rounded(features.scale(t.events.select("event_id", "value"), ["value"], how), ["value"])


def yeo_johnson_sql(x: str, lam: str) -> str:
    return f"""CASE WHEN {x} >= 0 THEN CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END
      WHEN {x} < 0 THEN CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END END"""


def power_sql(table: str, x: str) -> str:
    """The exponent by the same grids: (lam)."""
    steps = [f"b0 AS (SELECT 0.0::DOUBLE AS lam), t AS (SELECT count({x}) AS n, sum(sign({x}) * ln(1 + abs({x}))) AS t FROM {table})"]
    for i, (step, reach) in enumerate(features.POWER_STEPS):
        steps.append(
            f"""g{i} AS MATERIALIZED (SELECT j, lam + {step}::DOUBLE * j AS lam FROM b{i}, range({-reach}, {reach + 1}) AS r(j)),
            b{i + 1} AS MATERIALIZED (SELECT round(arg_max(lam, (ll, -j)), 6) AS lam FROM (
              SELECT j, g.lam, -0.5 * any_value(n) * ln(var_pop({yeo_johnson_sql(x, 'g.lam')})) + (g.lam - 1) * any_value(t) AS ll FROM {table}, g{i} g, t GROUP BY j, g.lam))"""
        )
    return f"WITH {', '.join(steps)} SELECT lam FROM b{len(features.POWER_STEPS)}"


@query("e9_power_transform", f"SELECT event_id, round({yeo_johnson_sql('value', 'lam')}, 4) AS value FROM events, ({power_sql('events', 'value')})")
def power(t):
    return rounded(features.power_transform(t.events.select("event_id", "value"), ["value"]), ["value"])


@query(
    "e10_polynomial_features",
    """SELECT l_orderkey, l_quantity, l_discount, round(l_quantity * l_quantity, 4) AS "l_quantity^2", round(l_quantity * l_discount, 4) AS "l_quantity l_discount",
       round(l_discount * l_discount, 4) AS "l_discount^2", round(l_quantity * l_quantity * l_quantity, 4) AS "l_quantity^3", round(l_quantity * l_quantity * l_discount, 4) AS "l_quantity^2 l_discount",
       round(l_quantity * l_discount * l_discount, 4) AS "l_quantity l_discount^2", round(l_discount * l_discount * l_discount, 4) AS "l_discount^3" FROM lineitem""",
)
def polynomial(t):
    return four(features.polynomial_features(t.lineitem.select("l_orderkey", "l_quantity", "l_discount"), ["l_quantity", "l_discount"], 3))


def axes_sql(source: str, width: int, k: int, turns: int = 30) -> str:
    """Principal axes of the lists x: the covariance is squared until one axis is left, which is taken out for the next: (m, a1, .., ak)."""
    each = f"range(1, {width + 1})"
    cell = lambda e: f"list_transform({each}, lambda i: list_transform({each}, lambda j: {e}))"
    trace = f"list_sum(list_transform({each}, lambda t: c[t][t]))"
    parts = [
        f"""z AS MATERIALIZED ({source}), mu AS MATERIALIZED (SELECT i, avg(x[i]) AS m FROM z, {each} AS r(i) GROUP BY i),
        cov AS (SELECT a.i, b.i AS j, avg((x[a.i] - a.m) * (x[b.i] - b.m)) AS v FROM z, mu a, mu b GROUP BY 1, 2),
        c1 AS MATERIALIZED (SELECT list(v ORDER BY i) AS c FROM (SELECT i, list(v ORDER BY j) AS v FROM cov GROUP BY i))"""
    ]
    for n in range(1, k + 1):
        parts.append(
            f"""p{n}(turn, c) AS (SELECT 0, {cell(f"c[i][j] / {trace}")} FROM c{n}
              UNION ALL SELECT turn + 1, {cell(f"c[i][j] / {trace}")}
              FROM (SELECT turn, {cell(f"list_sum(list_transform({each}, lambda h: c[i][h] * c[h][j]))")} AS c FROM p{n} WHERE turn < {turns})),
            d{n} AS (SELECT c[list_position(d, list_max(d))] AS w FROM (SELECT c, list_transform({each}, lambda i: c[i][i]) AS d FROM p{n} WHERE turn = {turns})),
            v{n} AS MATERIALIZED (SELECT list_transform(w, lambda e: e / sqrt(list_sum(list_transform(w, lambda f: f * f)))) AS v FROM d{n}),
            l{n} AS MATERIALIZED (SELECT v, list_sum(list_transform({each}, lambda i: v[i] * list_sum(list_transform({each}, lambda j: c[i][j] * v[j])))) AS size FROM v{n}, c{n}),
            c{n + 1} AS MATERIALIZED (SELECT {cell('c[i][j] - size * v[i] * v[j]')} AS c FROM c{n}, l{n})"""
        )
    signed = lambda n: f"(SELECT CASE WHEN list_max(v) >= -list_min(v) THEN v ELSE list_transform(v, lambda e: -e) END FROM l{n}) AS a{n}"
    return f"WITH RECURSIVE {', '.join(parts)} SELECT (SELECT list(m ORDER BY i) FROM mu) AS m, {', '.join(signed(n) for n in range(1, k + 1))}"


SCALED = ", ".join(f"(l.{c} - avg(l.{c}) OVER ()) / stddev_pop(l.{c}) OVER ()" for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query(
    "e11_pca",
    f"""SELECT l_orderkey, l_linenumber, {', '.join(f"round(list_sum(list_transform(range(1, 4), lambda i: (x[i] - m[i]) * a{n}[i])), 4) AS pc{n}" for n in (1, 2))}
    FROM (SELECT l_orderkey, l_linenumber, [{SCALED}] AS x FROM lineitem l), ({axes_sql(f"SELECT [{SCALED}] AS x FROM lineitem l", 3, 2)})""",
)
def components(t):
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    scaled = features.scale(base, ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(features.pca(scaled, ["l_quantity", "l_extendedprice", "l_discount"], 2).select("l_orderkey", "l_linenumber", "pc1", "pc2"), ["pc1", "pc2"])


@query(
    "e12_lag_features",
    f"""SELECT series, ts, value, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, lag(value, 7) OVER w AS value_lag7
    FROM ({GAPPY_DAILY}) WINDOW w AS (PARTITION BY series ORDER BY ts)""",
)
def lags(t):
    return features.lag_features(gappy_daily(t), {"value": [1, 2, 7]}, "ts", ["series"])


@query(
    "e12_lag_features_chunks",
    f"""SELECT series, ts, value, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, lag(value, 7) OVER w AS value_lag7
    FROM ({GAPPY_DAILY}) WINDOW w AS (PARTITION BY series ORDER BY ts)""",
)
def lags_chunks(t):
    """The same, with series cut into blocks as they are on large data."""
    return features.lag_features(gappy_daily(t), {"value": [1, 2, 7]}, "ts", ["series"], chunk_rows=1000)


CONFIG = {
    "log_transform": ["o_totalprice", "no such column"],
    "squared_transform": ["o_custkey"],
    "binning": [{"column": "o_totalprice", "bins": 2, "labels": ["low", "high"]}, {"column": "o_custkey", "bins": 3, "labels": ["a"]}],
    "one_hot_encoding": ["o_orderstatus"],
    "drop_first": True,
    "datetime_features": [{"column": "o_orderdate", "features": ["year", "dayofweek"]}],
    "columns_to_drop": ["o_rare", "o_empty", "o_orderpriority"],
    "data_types": {"o_custkey": "string"},
}


@query(
    "e13_apply_transformations",
    f"""WITH g AS ({GAPPY_ORDERS}), m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM g)
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, round(ln(1 + o_totalprice), 4) AS o_totalprice_log,
      round(o_custkey::DOUBLE * o_custkey, 4) AS o_custkey_squared, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice <= m THEN 'low' ELSE 'high' END AS o_totalprice_binned,
      coalesce(o_orderstatus = 'O', false) AS "o_orderstatus_O", coalesce(o_orderstatus = 'P', false) AS "o_orderstatus_P",
      CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek FROM g, m""",
)
def configured(t):
    return four(features.apply_transformations(gappy_orders(t), CONFIG)[0])


@query(
    "e13_applied_steps",
    """SELECT * FROM (VALUES (1, 'log', 'o_totalprice', ''), (2, 'squared', 'o_custkey', ''), (3, 'bins', 'o_totalprice', '2'),
      (4, 'one_hot', 'o_orderstatus', (SELECT CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders)), (5, 'date_parts', 'o_orderdate', 'year,dayofweek'),
      (6, 'drop', 'o_rare', ''), (7, 'drop', 'o_empty', ''), (8, 'drop', 'o_orderpriority', ''),
      (9, 'type', 'o_custkey', 'string')) AS v(step, kind, "column", setting)""",
)
def steps(t):
    _, applied = features.apply_transformations(gappy_orders(t), CONFIG)
    return t.spark.createDataFrame([(i + 1, *s) for i, s in enumerate(applied)], "step int, kind string, column string, setting string")


# --- the flagship ---------------------------------------------------------------

def clean_sql(price: str, source: str = "g") -> str:
    parts = {"year": "year(o_orderdate)", "month": "month(o_orderdate)", "day": "day(o_orderdate)", "dayofweek": "isodow(o_orderdate) - 1", "quarter": "quarter(o_orderdate)"}
    date_cols = ", ".join(f"CAST({e} AS INTEGER) AS o_orderdate_{p}" for p, e in parts.items())
    status = ", ".join(f"coalesce(o_orderstatus, {mode_of(source, 'o_orderstatus')}) = '{v}' AS \"o_orderstatus_{v}\"" for v in ("O", "P"))
    priority = ", ".join(
        f"coalesce(o_orderpriority, {mode_of(source, 'o_orderpriority')}) = '{v}' AS \"o_orderpriority_{v}\"" for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    return f"""SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, {mode_of(source, "o_orderstatus")}) AS o_orderstatus, {price} AS o_totalprice, o_orderdate,
      coalesce(o_orderpriority, {mode_of(source, "o_orderpriority")}) AS o_orderpriority, {date_cols}, {status}, {priority}"""


MEDIAN_CLEAN = f"""WITH g AS ({GAPPY_ORDERS}), m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM g)
{clean_sql("round(coalesce(o_totalprice, m), 4)")} FROM g, m"""


@query("e14_auto_clean", MEDIAN_CLEAN)
def cleaned(t):
    return four(auto_clean(gappy_orders(t), numeric="median").frame)


def knn_part(t):
    k = F.col("p_partkey")
    return t.part.select(
        F.when(k % 17 != 0, F.col("p_size")).alias("p_size"),
        F.when(k % 19 != 3, F.col("p_retailprice")).alias("p_retailprice"),
        F.when(k % 23 != 5, F.col("p_type")).alias("p_type"),
        k.cast("double").alias("p_partkey"),
    )


@query(
    "e14_auto_clean_knn",
    """WITH u AS (SELECT CASE WHEN p_partkey % 17 <> 0 THEN p_size END::DOUBLE AS p_size, CASE WHEN p_partkey % 19 <> 3 THEN p_retailprice END AS p_retailprice,
        CASE WHEN p_partkey % 23 <> 5 THEN p_type END AS p_type, p_partkey::DOUBLE AS p_partkey FROM part),
    d AS (SELECT r.p_partkey AS k, 'size' AS what, o.p_size AS v, sqrt((coalesce((r.p_partkey - o.p_partkey) * (r.p_partkey - o.p_partkey), 0) + coalesce((r.p_retailprice - o.p_retailprice) * (r.p_retailprice - o.p_retailprice), 0)) * 3.0
            / (1 + (r.p_retailprice IS NOT NULL AND o.p_retailprice IS NOT NULL)::INT)) AS dist, o.p_size AS o1, o.p_retailprice AS o2, o.p_partkey AS o3 FROM u r JOIN u o ON r.p_size IS NULL AND o.p_size IS NOT NULL
          UNION ALL
          SELECT r.p_partkey, 'price', o.p_retailprice, sqrt((coalesce((r.p_partkey - o.p_partkey) * (r.p_partkey - o.p_partkey), 0) + coalesce((r.p_size - o.p_size) * (r.p_size - o.p_size), 0)) * 3.0
            / (1 + (r.p_size IS NOT NULL AND o.p_size IS NOT NULL)::INT)), o.p_size, o.p_retailprice, o.p_partkey FROM u r JOIN u o ON r.p_retailprice IS NULL AND o.p_retailprice IS NOT NULL),
    n AS (SELECT k, what, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY k, what ORDER BY dist, o1 NULLS FIRST, o2 NULLS FIRST, o3) AS rn FROM d) WHERE rn <= 5 GROUP BY 1, 2),
    m AS (SELECT p_type FROM u WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1)
    SELECT round(coalesce(u.p_size, a.v), 4) AS p_size, round(coalesce(u.p_retailprice, b.v), 4) AS p_retailprice, u.p_partkey, coalesce(u.p_type, (SELECT p_type FROM m)) AS p_type, """
    + ", ".join(f"coalesce(u.p_type, (SELECT p_type FROM m)) = '{v}' AS \"p_type_{v}\"" for v in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + """ FROM u LEFT JOIN n a ON a.k = u.p_partkey AND a.what = 'size' LEFT JOIN n b ON b.k = u.p_partkey AND b.what = 'price'""",
)
def cleaned_knn(t):
    return four(auto_clean(knn_part(t)).frame)


@query(
    "e14_auto_clean_report",
    f"""WITH g AS ({GAPPY_ORDERS}), c AS (SELECT count(*) AS n, count(*) - count(o_orderstatus) AS a, count(*) - count(o_totalprice) AS b, count(*) - count(o_orderpriority) AS c, count(*) - count(o_rare) AS d FROM g)
    SELECT 'shape' AS section, CAST(NULL AS VARCHAR) AS "column", 'rows' AS detail, n::DOUBLE AS value FROM c
    UNION ALL SELECT 'shape', NULL, 'columns', 17 FROM c
    UNION ALL SELECT 'missing', 'o_orderstatus', 'mode=' || {mode_of("g", "o_orderstatus")}, a FROM c
    UNION ALL SELECT 'missing', 'o_totalprice', 'median', b FROM c
    UNION ALL SELECT 'missing', 'o_orderpriority', 'mode=' || {mode_of("g", "o_orderpriority")}, c FROM c
    UNION ALL SELECT 'missing', 'o_rare', 'none', d FROM c UNION ALL SELECT 'missing', 'o_empty', 'none', n FROM c
    UNION ALL SELECT 'dropped', 'o_rare', 'sparse', NULL UNION ALL SELECT 'dropped', 'o_empty', 'sparse', NULL
    UNION ALL SELECT 'dates', 'o_orderdate', 'parsed', NULL
    UNION ALL SELECT 'engineered', 'o_orderstatus', 'one_hot', 3 UNION ALL SELECT 'engineered', 'o_orderpriority', 'one_hot', 5""",
)
def clean_report(t):
    return auto_clean(gappy_orders(t), numeric="median").report


@query(
    "e15_auto_features",
    f"""WITH p AS (SELECT skewness(value) FILTER (value > 0) AS g FROM events),
    b AS (SELECT event_id, value, value_binned, event_type, ts FROM {codes_sql("events", "value", 4)})
    SELECT event_type, value, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') AS day, CAST(year(ts) AS INTEGER) AS day_year, CAST(month(ts) AS INTEGER) AS day_month, CAST(day(ts) AS INTEGER) AS day_day,
      CAST(isodow(ts) - 1 AS INTEGER) AS day_dayofweek, CAST(quarter(ts) AS INTEGER) AS day_quarter,
      event_type = 'error' AS event_type_error, event_type = 'purchase' AS event_type_purchase, event_type = 'signup' AS event_type_signup, event_type = 'view' AS event_type_view,
      round(CASE WHEN abs(g) > 1 THEN ln(1 + greatest(value, 0)) END, 4) AS value_log, round(sqrt(greatest(value, 0)), 4) AS value_sqrt,
      round(CASE WHEN value <> 0 THEN 1 / value END, 4) AS value_reciprocal, value_binned FROM b, p""",
)
def engineered(t):
    e = t.events.select("event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return four(auto_features(e)[0])


@query("e16_serve_frozen_params", MEDIAN_CLEAN)
def served(t):
    """Parameters learnt, written, read back and applied: equal to the training result."""
    g = gappy_orders(t)
    path = scratch_path(t.spark, "params")
    save_params(t.spark, auto_clean(g, numeric="median").params, path)
    return four(apply_params(g, load_params(t.spark, path)))
