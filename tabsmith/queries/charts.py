"""Queries behind charts (H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabsmith.operators import charts
from tabsmith.queries.profiling import rounded
from tabsmith.queries.registry import query


@query("h1_bar", "SELECT o_orderpriority AS label, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def bar(t):
    return rounded(charts.bar(t.orders, "o_orderpriority", "o_totalprice"), ["value"])


@query("h2_pie", "SELECT event_type AS label, round(sum(value), 2) AS value FROM events GROUP BY 1")
def pie(t):
    return rounded(charts.pie(t.events, "event_type", "value"), ["value"], 2)


@query("h3_line", "SELECT ts AS x, value AS y FROM events WHERE ts IS NOT NULL AND value IS NOT NULL ORDER BY 1, 2")
def line(t):
    return charts.line(t.events, "ts", "value")


@query("h4_scatter", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def scatter(t):
    return charts.scatter(t.lineitem, "l_quantity", "l_extendedprice")


@query(
    "h5_histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 20 AS w FROM events),
    b AS (SELECT CAST(least(floor((value - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM events, e GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, printf('%.2f-%.2f', lo + i * w, CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * w END) AS label, coalesce(n, 0) AS n
    FROM range(20) AS r(i) CROSS JOIN e LEFT JOIN b ON b.bin = r.i""",
)
def histogram(t):
    return charts.histogram(t.events, "value", 20)


def chart_sql(table: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        stats = (
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean"
            if kind == "numeric"
            else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean"
        )
        groupable = f"count(DISTINCT {c}) <= 20" if kind == "categorical" else "CAST(NULL AS BOOLEAN)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS category, count(*) - count({c}) AS nulls, {stats}, "
            f"count(DISTINCT {c}) AS \"distinct\", {groupable} AS groupable FROM {table}"
        )
    return " UNION ALL ".join(parts)


COLUMNS = {
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"), ("o_totalprice", "numeric"),
               ("o_orderdate", "datetime"), ("o_orderpriority", "categorical")],
    "lineitem": [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"),
                 ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"),
                 ("l_returnflag", "categorical"), ("l_linestatus", "categorical"), ("l_shipdate", "datetime")],
    "customer": [("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "categorical")],
    "part": [("p_partkey", "numeric"), ("p_name", "categorical"), ("p_brand", "categorical"), ("p_type", "categorical"), ("p_size", "numeric"), ("p_retailprice", "numeric")],
}


SAMPLES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY k) AS samples FROM
    (SELECT l.event_id AS k, CAST(l.{c} AS VARCHAR) AS v FROM events l WHERE l.{c} IS NOT NULL ORDER BY k LIMIT 5)"""
    for c in ("event_id", "user_id", "event_type", "props")
)


@query(
    "h6_chart_columns",
    f"""SELECT p.*, s.samples FROM ({chart_sql("events", [("event_id", "numeric"), ("user_id", "numeric"), ("event_type", "categorical"), ("props", "categorical")])}) p
    JOIN ({SAMPLES}) s USING ("column")""",
)
def columns(t):
    return rounded(charts.chart_columns(t.events.select("event_id", "user_id", "event_type", "props"), "event_id"), ["mean"])


EVENTS = [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "categorical"), ("value", "numeric"), ("props", "categorical")]
EVENT_SAMPLES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY k) AS samples FROM
    (SELECT l.event_id AS k, CAST(l.{c} AS VARCHAR) AS v FROM events l WHERE l.{c} IS NOT NULL ORDER BY k LIMIT 5)"""
    for c, _ in EVENTS
)


@query("h6_chart_columns_events", f"""SELECT p.*, s.samples FROM ({chart_sql("events", EVENTS)}) p JOIN ({EVENT_SAMPLES}) s USING ("column")""")
def event_columns(t):
    """All columns of the table, times and numbers among them."""
    return rounded(charts.chart_columns(t.events, "event_id"), ["mean"])


def suggestions_sql() -> str:
    cats = " UNION ALL ".join(f"SELECT '{d}' AS dataset, * FROM ({chart_sql(d, c)})" for d, c in COLUMNS.items())
    return f"""WITH k AS ({cats}),
    p AS (SELECT *, row_number() OVER (PARTITION BY dataset, category ORDER BY position) AS place FROM k),
    num AS (SELECT * FROM p WHERE category = 'numeric'), cat AS (SELECT * FROM p WHERE category = 'categorical'), day AS (SELECT * FROM p WHERE category = 'datetime'),
    s AS (
      SELECT c.dataset, 1 AS rule, c.place AS i, n.place AS j, 'bar' AS chart, c."column" AS x, n."column" AS y FROM cat c JOIN num n USING (dataset)
        WHERE c.place <= 3 AND n.place <= 3 AND c."distinct" <= 15
      UNION ALL SELECT a.dataset, 2, a.place, b.place, 'scatter', a."column", b."column" FROM num a JOIN num b USING (dataset)
        WHERE a.place <= 3 AND b.place <= 4 AND b.place > a.place
      UNION ALL SELECT d.dataset, 3, d.place, n.place, 'line', d."column", n."column" FROM day d JOIN num n USING (dataset) WHERE d.place <= 2 AND n.place <= 3
      UNION ALL SELECT c.dataset, 4, c.place, n.place, 'pie', c."column", n."column" FROM cat c JOIN num n USING (dataset)
        WHERE c.place <= 3 AND n.place = 1 AND c."distinct" BETWEEN 2 AND 10)
    SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY rule, i, j) AS INTEGER) AS rank, chart, x, y FROM s QUALIFY rank <= 10"""


@query("h7_suggest_charts", suggestions_sql())
def suggestions(t):
    frames = [charts.chart_columns(getattr(t, d)).withColumn("dataset", F.lit(d)) for d in COLUMNS]
    return charts.suggest_charts(reduce(DataFrame.unionByName, frames))
