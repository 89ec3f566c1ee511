"""Queries for dates (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions import date_rules as rules
from tabsmith.operators import dates
from tabsmith.queries.fixtures import DATED_ORDERS, dated_orders
from tabsmith.queries.profiling import union_sql
from tabsmith.queries.registry import query

TEXTS = ["iso_date", "mixed", "euro", "remark", "o_orderpriority"]


def listed(c: str) -> str:
    tries = [f"CASE WHEN regexp_full_match({c}, '{shape}') THEN try_strptime({c}, '{f}') END" for _, f, shape in rules.DATE_FORMATS]
    return f"coalesce({', '.join(tries)})"


def flexible(c: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({c}, '^\\d{{4}}\\D') THEN TRY_CAST({c} AS TIMESTAMP) END, {listed(c)})"


def evidence_sql() -> str:
    parts = []
    pattern = "|".join(rules.TABLE_DATE_PATTERNS)
    for c in TEXTS:
        hint = any(h in c for h in rules.TABLE_DATE_NAMES)
        parts.append(
            f"""SELECT '{c}' AS "column", round(count(*) FILTER (regexp_matches({c}, '{pattern}')) * 1.0 / count({c}), 4) AS match_ratio,
            round(count({flexible(c)}) * 1.0 / count({c}), 4) AS parse_ratio, {str(hint).lower()} AS name_hint FROM d"""
        )
    return f"""WITH d AS ({DATED_ORDERS})
      SELECT *, (name_hint AND match_ratio > 0) OR (match_ratio > 0.5 AND parse_ratio > 0.5) AS is_date FROM ({union_sql(parts)})"""


@query("c1_detect_date_columns", evidence_sql())
def detect(t):
    return dates.date_evidence(dated_orders(t).select(*TEXTS))


@query(
    "c2_detect_date_columns_ts",
    f"""WITH d AS ({DATED_ORDERS}),
    r AS (SELECT min(epoch) AS lo, max(epoch) AS hi, min(epoch_ms) AS mlo, max(epoch_ms) AS mhi,
       {", ".join(f"count(*) FILTER (regexp_matches({c}, '" + "|".join(rules.SERIES_DATE_PATTERNS) + f"')) * 1.0 / count({c}) AS m_{c}, count({flexible(c)}) * 1.0 / count({c}) AS p_{c}" for c in TEXTS)} FROM d)
    SELECT 'iso_date' AS "column", 'name and content' AS reason FROM r WHERE m_iso_date > 0.2 OR p_iso_date > 0.2
    UNION ALL SELECT 'mixed', 'content' FROM r WHERE m_mixed > 0.2 OR p_mixed > 0.2
    UNION ALL SELECT 'euro', 'content' FROM r WHERE m_euro > 0.2 OR p_euro > 0.2
    UNION ALL SELECT 'remark', 'content' FROM r WHERE m_remark > 0.2 OR p_remark > 0.2
    UNION ALL SELECT 'o_orderpriority', 'content' FROM r WHERE m_o_orderpriority > 0.2 OR p_o_orderpriority > 0.2
    UNION ALL SELECT 'epoch', 'epoch seconds' FROM r WHERE lo > 946684800 AND hi < 1893456000
    UNION ALL SELECT 'epoch_ms', 'epoch millis' FROM r WHERE mlo > 946684800000 AND mhi < 1893456000000
    UNION ALL SELECT 'typed', 'typed'""",
)
def detect_ts(t):
    return dates.detect_date_columns_ts(dated_orders(t))


@query(
    "c3_score_time_columns",
    f"""WITH d AS (SELECT event_id, ts, CAST(epoch(ts) AS BIGINT) AS made, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created, event_type, value FROM events),
    o AS (SELECT *, lag(ts) OVER w AS pts, lag(made) OVER w AS pm, lag(created) OVER w AS pc FROM d WINDOW w AS (ORDER BY event_id)),
    f AS (SELECT count(*) FILTER (ts < pts) = 0 AS a, count(*) FILTER (made < pm) = 0 AS b, count(*) FILTER (created < pc) = 0 AS c FROM o),
    s AS (SELECT 'ts' AS "column", 1 AS pos, 50 + CASE WHEN a THEN 15 ELSE 0 END AS score, true AS is_datetime, false AS parseable, false AS has_keyword FROM f
      UNION ALL SELECT 'made', 2, 30 + CASE WHEN b THEN 15 ELSE 0 END, false, true, false FROM f
      UNION ALL SELECT 'created', 3, 50 + CASE WHEN c THEN 15 ELSE 0 END, false, true, true FROM f)
    SELECT CAST(row_number() OVER (ORDER BY score DESC, pos) AS INTEGER) AS rank, "column", CAST(score AS INTEGER) AS score, is_datetime, parseable, has_keyword FROM s""",
)
def scored(t):
    e = t.events.select(
        "event_id", "ts", F.unix_timestamp("ts").alias("made"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created"), "event_type", "value",
    )
    return dates.score_time_columns(e, "event_id")


@query(
    "c4_date_format_coverage",
    f"WITH d AS ({DATED_ORDERS}) "
    + union_sql(
        [
            f"SELECT {i + 1} AS position, '{f}' AS format, count(CASE WHEN regexp_full_match(mixed, '{shape}') THEN try_strptime(mixed, '{f}') END) AS hits, count(mixed) AS \"values\" FROM d"
            for i, (_, f, shape) in enumerate(rules.DATE_FORMATS)
        ]
    ),
)
def coverage(t):
    return dates.format_coverage(dated_orders(t), "mixed")


def best_sql(c: str) -> str:
    counts = union_sql(
        [
            f"SELECT {i} AS p, '{f}' AS f, count(CASE WHEN regexp_full_match({c}, '{shape}') THEN try_strptime({c}, '{f}') END) AS n, count({c}) AS v FROM d"
            for i, (_, f, shape) in enumerate(rules.DATE_FORMATS)
        ]
    )
    return f"SELECT '{c}' AS \"column\", CASE WHEN n >= 0.5 * v THEN f END AS format FROM (SELECT * FROM ({counts}) ORDER BY n DESC, p LIMIT 1)"


@query("c4_detect_date_format", f"WITH d AS ({DATED_ORDERS}) " + union_sql([f"SELECT * FROM ({best_sql(c)})" for c in ("iso_date", "euro", "mixed")]))
def best_format(t):
    d = dated_orders(t)
    rows = [(c, dates.detect_date_format(d, c)) for c in ("iso_date", "euro", "mixed")]
    return t.spark.createDataFrame(rows, "column string, format string")


@query("c5_parse_mixed_dates", f"SELECT o_orderkey, {listed('mixed')} AS mixed, {listed('remark')} AS remark FROM ({DATED_ORDERS})")
def mixed(t):
    return dates.parse_mixed_dates(dated_orders(t).select("o_orderkey", "mixed", "remark"), ["mixed", "remark"])


@query(
    "c6_smart_parse",
    """SELECT event_id, date_trunc('second', ts) AS euro, date_trunc('second', ts) AS epoch, date_trunc('millisecond', ts) AS epoch_ms, event_type FROM events""",
)
def smart(t):
    out = t.events.select(
        "event_id",
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("euro"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"),
        "event_type",
    )
    for c in ("euro", "epoch", "epoch_ms", "event_type"):
        out = dates.smart_parse(out, c)
    return out


@query(
    "c7_date_features",
    f"""SELECT o_orderkey, CAST(year(typed) AS INTEGER) AS iso_date_year, CAST(month(typed) AS INTEGER) AS iso_date_month, CAST(day(typed) AS INTEGER) AS iso_date_day,
      CAST(isodow(typed) - 1 AS INTEGER) AS iso_date_dayofweek, CAST(quarter(typed) AS INTEGER) AS iso_date_quarter, typed AS iso_date FROM ({DATED_ORDERS})""",
)
def features(t):
    return dates.date_features(dated_orders(t).select("o_orderkey", "iso_date"), ["iso_date"])


@query(
    "c8_date_span",
    'SELECT min(l_shipdate) AS start, max(l_shipdate) AS "end", count(l_shipdate) AS rows, count(l_shipdate) - count(DISTINCT l_shipdate) AS duplicates FROM lineitem',
)
def span(t):
    return dates.date_span(t.lineitem, "l_shipdate")
