"""Queries for projections, filters and cleaning (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import clean
from tabsmith.queries.fixtures import (
    DIRTY_CUSTOMER,
    GAPPY_ORDERS,
    GAPPY_PART,
    dirty_customer,
    gappy_orders,
    gappy_part,
)
from tabsmith.queries.profiling import rounded
from tabsmith.operators.isolation import trim_isolated_rows
from tabsmith.queries.registry import query

TOKENS = ", ".join(f"'{v}'" for v in clean.TABLE_NULL_TOKENS)


@query(
    "b1_null_tokens",
    f"""SELECT c_custkey, CASE WHEN segment NOT IN ({TOKENS}) THEN segment END AS segment,
      CASE WHEN balance NOT IN ({TOKENS}) THEN balance END AS balance,
      CASE WHEN points NOT IN ({TOKENS}) THEN points END AS points,
      CASE WHEN name NOT IN ({TOKENS}) THEN name END AS name FROM ({DIRTY_CUSTOMER})""",
)
def null_tokens(t):
    return clean.null_tokens(dirty_customer(t))


@query(
    "b2_blank_to_null",
    f"""SELECT c_custkey, nullif(trim(segment), '') AS segment, nullif(trim(balance), '') AS balance,
      nullif(trim(points), '') AS points, nullif(trim(name), '') AS name FROM ({DIRTY_CUSTOMER})""",
)
def blank(t):
    return clean.blank_to_null(dirty_customer(t))


def emptied(t):
    gone = F.col("o_orderkey") % 3 == 0
    return t.orders.select(*[F.when(~gone, F.col(c)).alias(c) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")])


@query(
    "b3_drop_empty_rows",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0",
)
def empty_rows(t):
    return clean.drop_empty_rows(emptied(t))


@query(
    "b3_empty_row_report",
    "SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 3 = 0) AS dropped FROM orders",
)
def empty_report(t):
    return clean.empty_row_count(emptied(t))


@query(
    "b4_drop_empty_columns",
    f"SELECT * EXCLUDE (o_empty) FROM ({GAPPY_ORDERS})",
)
def empty_columns(t):
    return clean.drop_empty_columns(gappy_orders(t))


@query("b5_drop_duplicate_columns", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def duplicate_columns(t):
    n = t.nation
    return clean.drop_duplicate_columns(n.select("n_nationkey", "n_name", F.upper("n_name").alias("n_name"), "n_regionkey"))


@query("b6_drop_sparse_columns", f"SELECT * EXCLUDE (o_empty, o_rare) FROM ({GAPPY_ORDERS})")
def sparse(t):
    return clean.drop_sparse_columns(gappy_orders(t))


@query("b7_drop_constant_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def constant(t):
    c = t.customer
    return clean.drop_constant_columns(
        c.select("c_custkey", "c_mktsegment", F.lit("EU").alias("zone"), F.lit(None).cast("double").alias("none"))
    )


@query("b8_drop_columns", "SELECT p_partkey, p_name, p_size FROM part")
def dropped(t):
    return clean.drop_columns(t.part, ["p_brand", "p_type", "p_retailprice", "not there"])


@query(
    "b9_align_columns",
    "SELECT s_acctbal, CAST(NULL AS VARCHAR) AS s_phone, s_suppkey FROM supplier",
)
def aligned(t):
    return clean.align_columns(t.supplier, {"s_acctbal": "double", "s_phone": "string", "s_suppkey": "bigint"})


@query("b10_select_features", "SELECT l_quantity, l_discount, l_returnflag FROM lineitem")
def selected(t):
    return clean.select_features(t.lineitem, ["l_quantity", "l_discount"], "l_returnflag")


@query(
    "b11_drop_index_columns",
    "SELECT s_suppkey, s_acctbal AS acct_scaled, 'acct_scaled' AS suspects FROM supplier",
)
def index_columns(t):
    df = t.supplier.select("s_suppkey", F.col("s_suppkey").alias("Unnamed: 0"), F.col("s_acctbal").alias("acct_scaled"))
    kept = clean.drop_index_columns(df)
    return kept.withColumn("suspects", F.lit(",".join(clean.leakage_suspects(kept.columns))))


@query(
    "b12_inf_to_null_fill",
    f"""WITH g AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 2 END AS half, o_orderstatus FROM ({GAPPY_ORDERS})),
    m AS (SELECT quantile_cont(o_totalprice, 0.5) AS a, quantile_cont(half, 0.5) AS b FROM g)
    SELECT o_orderkey, round(coalesce(o_totalprice, a), 4) AS o_totalprice, round(coalesce(half, b), 4) AS half, coalesce(o_orderstatus, '') AS o_orderstatus FROM g, m""",
)
def inf_fill(t):
    g = gappy_orders(t)
    k = F.col("o_orderkey")
    bad = F.when(k % 18 == 0, F.lit(float("inf"))).when(k % 9 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 2)
    return rounded(
        clean.inf_to_null_fill(g.select("o_orderkey", "o_totalprice", bad.alias("half"), "o_orderstatus")),
        ["o_totalprice", "half"],
    )


@query(
    "b13_residual_fill",
    f"""SELECT o_orderkey, coalesce(o_totalprice, 0) AS o_totalprice, coalesce(o_orderstatus, 'Unknown') AS o_orderstatus,
      CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS o_orderdate FROM ({GAPPY_ORDERS})""",
)
def residual(t):
    g = gappy_orders(t)
    late = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("o_orderdate")
    return clean.residual_fill(g.select("o_orderkey", "o_totalprice", "o_orderstatus", late))


@query(
    "b14_convert_types",
    """SELECT TRY_CAST(o_orderkey AS BIGINT) AS a, o_totalprice AS b, CAST(o_totalprice AS FLOAT) AS c,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS d, CAST(o_custkey AS VARCHAR) AS e FROM orders""",
)
def converted(t):
    o = t.orders.select(
        F.col("o_orderkey").cast("string").alias("a"),
        F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("b"),
        F.col("o_totalprice").alias("c"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("never")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.col("o_custkey").alias("e"),
    )
    return clean.convert_types(o, {"a": "int", "b": "int", "c": "float", "d": "datetime", "e": "string"})


@query(
    "b15_numeric_if_mostly",
    f"SELECT c_custkey, segment, TRY_CAST(replace(points, ',', '') AS DOUBLE) AS points, name FROM ({DIRTY_CUSTOMER})",
)
def mostly(t):
    return clean.numeric_if_mostly(dirty_customer(t).drop("balance"))


@query(
    "b16_currency_to_number",
    f"SELECT c_custkey, TRY_CAST(regexp_replace(balance, '[,$%]', '', 'g') AS DOUBLE) AS balance FROM ({DIRTY_CUSTOMER})",
)
def currency(t):
    return clean.currency_to_number(dirty_customer(t).select("c_custkey", "balance"), ["balance"])


@query(
    "b17_drop_null_keys",
    f"SELECT o_orderkey, o_totalprice, o_orderstatus FROM ({GAPPY_ORDERS}) WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL",
)
def null_keys(t):
    return clean.drop_null_keys(gappy_orders(t).select("o_orderkey", "o_totalprice", "o_orderstatus"), ["o_totalprice", "o_orderstatus"])


@query("b18_drop_duplicate_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def duplicates(t):
    return clean.drop_duplicate_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query(
    "b19_flag_outliers_iqr",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS value_outlier FROM events, q""",
)
def iqr(t):
    return clean.flag_outliers_iqr(t.events.select("event_id", "value"), ["value"], 1.5)


@query(
    "b20_flag_outliers_zscore",
    """WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
    SELECT event_id, value, abs(value - m) > 3 * s AS value_outlier FROM events, q""",
)
def zscore(t):
    return clean.flag_outliers_zscore(t.events.select("event_id", "value"), ["value"], 3.0)


@query(
    "b21_clip_outliers",
    f"""WITH g AS (SELECT o_orderkey, o_totalprice FROM ({GAPPY_ORDERS})),
    q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM g)
    SELECT o_orderkey, round(CASE WHEN o_totalprice IS NOT NULL THEN greatest(least(o_totalprice, b + 0.1 * (b - a)), a - 0.1 * (b - a)) END, 4) AS o_totalprice FROM g, q""",
)
def clipped(t):
    g = gappy_orders(t).select("o_orderkey", "o_totalprice")
    return rounded(clean.clip_outliers(g, clean.iqr_bounds(g, ["o_totalprice"], 0.1)), ["o_totalprice"])


@query("b22_isolation_forest")
def isolated(t):
    """The rows that a forest of random cuts keeps; the tests walk the same trees in plain Python."""
    return trim_isolated_rows(gappy_part(t).select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 0.05)


@query(
    "b22_trim_outlier_rows",
    f"""WITH g AS ({GAPPY_PART}),
    m AS (SELECT avg(p_size) AS a, stddev_samp(p_size) AS s, avg(p_retailprice) AS b, stddev_samp(p_retailprice) AS u FROM g),
    d AS (SELECT p_partkey, p_size, p_retailprice, greatest(coalesce(abs(p_size - a) / s, 0), coalesce(abs(p_retailprice - b) / u, 0)) AS d FROM g, m),
    c AS (SELECT quantile_cont(d, 0.95) AS cut FROM d)
    SELECT p_partkey, p_size, p_retailprice FROM d, c WHERE d <= cut + 1e-12""",
)
def trimmed(t):
    g = gappy_part(t).select("p_partkey", "p_size", "p_retailprice")
    return clean.trim_outlier_rows(g, ["p_size", "p_retailprice"], 0.05)
