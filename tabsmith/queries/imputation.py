"""Queries for imputation (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import impute
from tabsmith.operators.neighbours import impute_knn
from tabsmith.queries.fixtures import (
    GAPPY_DAILY,
    GAPPY_ORDERS,
    GAPPY_PART,
    gappy_daily,
    gappy_orders,
    gappy_part,
)
from tabsmith.queries.profiling import rounded
from tabsmith.queries.registry import query


def mode_of(source: str, c: str) -> str:
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "d1_impute_mode",
    f"""WITH g AS ({GAPPY_ORDERS}) SELECT o_orderkey, coalesce(o_orderstatus, {mode_of("g", "o_orderstatus")}) AS o_orderstatus,
      coalesce(o_orderpriority, {mode_of("g", "o_orderpriority")}) AS o_orderpriority, 'Unknown' AS o_empty FROM g""",
)
def mode(t):
    g = gappy_orders(t).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_empty")
    return impute.impute_mode(g, ["o_orderstatus", "o_orderpriority", "o_empty"])


@query(
    "d2_impute_median",
    f"""WITH g AS ({GAPPY_ORDERS}), m AS (SELECT quantile_cont(o_totalprice, 0.5) AS a, quantile_cont(o_rare, 0.5) AS b FROM g)
    SELECT o_orderkey, round(coalesce(o_totalprice, a), 4) AS o_totalprice, round(coalesce(o_rare, b), 4) AS o_rare FROM g, m""",
)
def median(t):
    g = gappy_orders(t).select("o_orderkey", "o_totalprice", "o_rare")
    return rounded(impute.impute_median(g, ["o_totalprice", "o_rare"]), ["o_totalprice", "o_rare"])


@query(
    "d3_impute_mean",
    f"""WITH g AS ({GAPPY_ORDERS}), m AS (SELECT avg(o_totalprice) AS a FROM g)
    SELECT o_orderkey, round(coalesce(o_totalprice, a), 4) AS o_totalprice FROM g, m""",
)
def mean(t):
    return rounded(impute.impute_mean(gappy_orders(t).select("o_orderkey", "o_totalprice"), ["o_totalprice"]), ["o_totalprice"])


def knn_sql(source: str, columns: list[str], other: list[str]) -> str:
    d = len(columns)
    terms = " + ".join(f"coalesce((r.{c} - o.{c}) * (r.{c} - o.{c}), 0.0)" for c in columns)
    both = " + ".join(f"(r.{c} IS NOT NULL AND o.{c} IS NOT NULL)::INT" for c in columns)
    same = ", ".join(f"o.{c}" for c in columns)
    parts, ctes = [], []
    for c in columns:
        keys = ", ".join(f"r.{x} AS k_{x}" for x in columns)
        ctes.append(
            f"""p_{c} AS (SELECT {keys}, o.{c} AS v, row_number() OVER (PARTITION BY r.rid ORDER BY sqrt(({terms}) * {float(d)} / ({both})), {same.replace(", ", " NULLS FIRST, ")} NULLS FIRST) AS rn, r.rid AS rid
            FROM u r JOIN u o ON r.{c} IS NULL AND o.{c} IS NOT NULL AND ({both}) > 0),
            n_{c} AS (SELECT rid, avg(v) AS v FROM p_{c} WHERE rn <= 5 GROUP BY rid)"""
        )
        parts.append(f"round(coalesce(u.{c}, n_{c}.v, (SELECT avg({c}) FROM u)), 4) AS {c}")
    joins = " ".join(f"LEFT JOIN n_{c} ON n_{c}.rid = u.rid" for c in columns)
    return f"""WITH u AS (SELECT {', '.join(other)}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in columns)}, row_number() OVER (ORDER BY {other[0]}) AS rid FROM ({source})),
    {', '.join(ctes)} SELECT {', '.join('u.' + c for c in other)}, {', '.join(parts)} FROM u {joins}"""


@query("d4_impute_knn", knn_sql(f"SELECT *, p_partkey % 97 AS code FROM ({GAPPY_PART})", ["p_size", "p_retailprice", "code"], ["p_partkey"]))
def knn(t):
    g = gappy_part(t).select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 97).cast("double").alias("code"))
    return rounded(impute_knn(g, ["p_size", "p_retailprice", "code"]), ["p_size", "p_retailprice"])


@query("d4_impute_knn_buckets", knn_sql(f"SELECT *, p_partkey % 97 AS code FROM ({GAPPY_PART})", ["p_size", "p_retailprice", "code"], ["p_partkey"]))
def knn_buckets(t):
    """The same with many small cells: the bounded search must give the same rows."""
    g = gappy_part(t).select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 97).cast("double").alias("code"))
    return rounded(impute_knn(g, ["p_size", "p_retailprice", "code"], cell_rows=100), ["p_size", "p_retailprice"])


SERIES = "PARTITION BY series ORDER BY ts"
BACK = f"OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = f"OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "d5_ffill",
    f"SELECT series, ts, coalesce(last_value(value IGNORE NULLS) {BACK}, 0) AS value FROM ({GAPPY_DAILY})",
)
def forward(t):
    return impute.ffill(gappy_daily(t), ["value"], "ts", ["series"])


@query(
    "d5_ffill_limit",
    f"""WITH g AS (SELECT *, row_number() OVER ({SERIES}) AS p FROM ({GAPPY_DAILY})),
    l AS (SELECT *, last_value(value IGNORE NULLS) {BACK} AS v, max(CASE WHEN value IS NOT NULL THEN p END) {BACK} AS q FROM g)
    SELECT series, ts, coalesce(value, CASE WHEN p - q <= 1 THEN v END, 0) AS value FROM l""",
)
def forward_limit(t):
    return impute.ffill(gappy_daily(t), ["value"], "ts", ["series"], limit=1)


@query(
    "d6_bfill",
    f"SELECT series, ts, coalesce(first_value(value IGNORE NULLS) {AHEAD}, 0) AS value FROM ({GAPPY_DAILY})",
)
def backward(t):
    return impute.bfill(gappy_daily(t), ["value"], "ts", ["series"])


def interpolated(source: str) -> str:
    return f"""SELECT series, ts, coalesce(value, CASE WHEN np > pp THEN pv + (nv - pv) * (p - pp) / (np - pp) END, pv, nv, 0) AS value FROM (
      SELECT *, last_value(value IGNORE NULLS) {BACK} AS pv, first_value(value IGNORE NULLS) {AHEAD} AS nv,
        max(CASE WHEN value IS NOT NULL THEN p END) {BACK} AS pp, min(CASE WHEN value IS NOT NULL THEN p END) {AHEAD} AS np
      FROM (SELECT *, row_number() OVER ({SERIES}) AS p FROM ({source})))"""


def rolled(source: str, rows: int, leftover: str) -> str:
    return f"""SELECT series, ts, coalesce(value, avg(value) OVER ({SERIES} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW), {leftover}) AS value FROM ({source})"""


def final(source: str) -> str:
    return f"SELECT series, ts, round(value, 7) AS value FROM ({source})"


@query("d7_interpolate_linear", final(interpolated(GAPPY_DAILY)))
def linear(t):
    return rounded(impute.interpolate_linear(gappy_daily(t), ["value"], "ts", ["series"]), ["value"], 7)


@query("d8_impute_rolling", final(rolled(GAPPY_DAILY, 3, "0")))
def rolling(t):
    return rounded(impute.impute_rolling(gappy_daily(t), ["value"], "ts", ["series"], 3), ["value"], 7)


@query("d9_impute_auto_ts", final(interpolated(rolled(GAPPY_DAILY, 3, "NULL"))))
def auto(t):
    return rounded(impute.impute_auto_ts(gappy_daily(t), ["value"], "ts", ["series"]), ["value"], 7)


@query("d9_impute_auto_ts_chunks", final(interpolated(rolled(GAPPY_DAILY, 3, "NULL"))))
def auto_chunks(t):
    """The same, with series cut into chunks as they are on large data."""
    return rounded(impute.impute_auto_ts(gappy_daily(t), ["value"], "ts", ["series"], chunk_rows=1500), ["value"], 7)


WIDE = f"""SELECT series, ts, value, CASE WHEN dayofyear(ts) % 4 <> 1 THEN value / 2 END AS half, CASE WHEN dayofyear(ts) % 6 <> 2 THEN value * 2 END AS twice FROM ({GAPPY_DAILY})"""


def wide(t):
    day = F.dayofyear("ts")
    return gappy_daily(t).select(
        "series", "ts", "value",
        F.when(day % 4 != 1, F.col("value") / 2).alias("half"),
        F.when(day % 6 != 2, F.col("value") * 2).alias("twice"),
    )


CONFIG = {"half": {"method": "rolling", "window_size": 4}, "twice": {"method": "median"}}


@query(
    "d10_impute_by_config",
    f"""WITH w AS ({WIDE}), m AS (SELECT quantile_cont(twice, 0.5) AS q FROM w)
    SELECT i.series, i.ts, round(i.value, 7) AS value, round(r.value, 7) AS half, round(coalesce(w.twice, q), 7) AS twice
    FROM ({interpolated("SELECT series, ts, value FROM w")}) i JOIN ({rolled("SELECT series, ts, half AS value FROM w", 4, "0")}) r USING (series, ts) JOIN w USING (series, ts), m""",
)
def by_config(t):
    out, _ = impute.impute_by_config(wide(t), "ts", ["series"], CONFIG, "interpolate")
    return rounded(out, ["value", "half", "twice"], 7)


@query(
    "d10_impute_report",
    f"""WITH w AS ({WIDE})
    SELECT 'value' AS "column", 'interpolate' AS method, count(*) - count(value) AS missing_before, 0::BIGINT AS missing_after, count(*) - count(value) AS filled FROM w
    UNION ALL SELECT 'half', 'rolling', count(*) - count(half), 0, count(*) - count(half) FROM w
    UNION ALL SELECT 'twice', 'median', count(*) - count(twice), 0, count(*) - count(twice) FROM w""",
)
def config_report(t):
    return impute.impute_by_config(wide(t), "ts", ["series"], CONFIG, "interpolate")[1]


@query(
    "d11_impute_target",
    f"""WITH g AS ({GAPPY_ORDERS}) SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM g)), 4) AS o_totalprice,
      coalesce(o_orderstatus, {mode_of("g", "o_orderstatus")}) AS o_orderstatus FROM g""",
)
def target(t):
    g = gappy_orders(t).select("o_orderkey", "o_totalprice", "o_orderstatus")
    filled = impute.impute_target(impute.impute_target(g, "o_totalprice", "regression"), "o_orderstatus", "classification")
    return rounded(filled, ["o_totalprice"])
