"""Queries for time-series preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import timeseries as ts
from tabsmith.queries.fixtures import DAILY, GAPPY_DAILY, MONTHLY, daily, gappy_daily, monthly
from tabsmith.queries.imputation import final, interpolated, rolled
from tabsmith.queries.profiling import rounded
from tabsmith.queries.registry import query

GRID_TESTS = {
    "D": "true",
    "B": "isodow(ts) < 6",
    "W": "isodow(ts) = 7",
    "M": "last_day(ts) = CAST(ts AS DATE)",
    "Q": "last_day(ts) = CAST(ts AS DATE) AND month(ts) % 3 = 0",
    "A": "last_day(ts) = CAST(ts AS DATE) AND month(ts) = 12",
}
for _freq, _test in GRID_TESTS.items():

    @query(
        f"g1_as_frequency_{_freq.lower()}",
        f"SELECT series, ts, value FROM ({GAPPY_DAILY}) WHERE {_test} AND value IS NOT NULL",
    )
    def on_grid(t, freq=_freq):
        return ts.as_frequency(gappy_daily(t), "ts", freq, ["series"])


for _freq, _unit in {"H": 3600, "T": 60, "S": 1}.items():

    @query(
        f"g1_as_frequency_{_freq.lower()}",
        f"""WITH e AS (SELECT date_trunc('second', ts) AS ts, event_type, avg(value) AS value FROM events GROUP BY 1, 2),
        f AS (SELECT event_type, min(ts) AS lo FROM e GROUP BY 1)
        SELECT event_type, ts, round(value, 4) AS value FROM e JOIN f USING (event_type) WHERE (epoch_us(ts) - epoch_us(lo)) % {_unit * 1000000} = 0""",
    )
    def on_fine_grid(t, freq=_freq):
        e = t.events.groupBy(F.date_trunc("second", "ts").alias("ts"), "event_type").agg(F.avg("value").alias("value"))
        return rounded(ts.as_frequency(e, "ts", freq, ["event_type"]), ["value"])


@query("g2_dedupe_timestamps", "SELECT l_returnflag, l_shipdate, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY 1, 2")
def deduped(t):
    lines = t.lineitem.select("l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice")
    return rounded(ts.dedupe_timestamps(lines, "l_shipdate", ["l_returnflag"]), ["l_quantity", "l_extendedprice"], 6)


MIXED = f"""
  SELECT 'daily ' || series AS series, ts, value FROM ({DAILY})
  UNION ALL SELECT 'workdays', ts, value FROM ({DAILY}) WHERE series = '1-URGENT' AND isodow(ts) < 6
  UNION ALL SELECT 'month start', ts, value FROM ({MONTHLY}) WHERE series = '1-URGENT'
  UNION ALL SELECT 'mondays', CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, sum(value) FROM ({DAILY}) WHERE series = '5-LOW' GROUP BY 2
"""


def mixed(t):
    d, m = daily(t), monthly(t)
    weekly = d.filter("series = '5-LOW'").groupBy(F.date_trunc("week", "ts").alias("ts")).agg(F.sum("value").alias("value"))
    return (
        d.withColumn("series", F.concat(F.lit("daily "), F.col("series")))
        .unionByName(d.filter((F.col("series") == "1-URGENT") & (F.weekday("ts") < 5)).withColumn("series", F.lit("workdays")))
        .unionByName(m.filter("series = '1-URGENT'").withColumn("series", F.lit("month start")))
        .unionByName(weekly.withColumn("series", F.lit("mondays")))
    )


@query(
    "g3_detect_frequency",
    f"""WITH m AS ({MIXED}), s AS (SELECT *, lag(ts) OVER (PARTITION BY series ORDER BY ts) AS p FROM m),
    g AS (SELECT series, date_diff('day', p, ts) AS gap, count(*) AS n FROM s WHERE p IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT series, count(*) AS kinds, arg_min(gap, (-n, gap)) AS mode FROM (SELECT *, n FROM g) GROUP BY 1),
    w AS (SELECT series, bool_or(isodow(ts) >= 6) AS weekend, bool_and(day(ts) = 1) AS firsts,
       bool_and(p IS NULL OR date_diff('month', p, ts) = 1) AS steps FROM s GROUP BY 1)
    SELECT series, CASE WHEN firsts AND steps THEN 'M' WHEN kinds = 1 AND mode = 7 THEN 'W' WHEN mode = 1 AND weekend THEN 'D' WHEN mode = 1 THEN 'B' WHEN mode = 7 THEN 'W' WHEN mode BETWEEN 28 AND 31 THEN 'M' END AS frequency
    FROM k JOIN w USING (series)""",
)
def frequency(t):
    return ts.detect_frequency(mixed(t), "ts", ["series"])


GRID = f"""SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM (SELECT series, min(ts) AS lo, max(ts) AS hi FROM ({DAILY}) GROUP BY 1)"""


@query("g4_fill_grid", f"SELECT g.series, g.ts, d.value FROM ({GRID}) g LEFT JOIN ({DAILY}) d USING (series, ts)")
def grid(t):
    return ts.fill_grid(daily(t), "ts", ["series"])


@query("g4_regularise", final(interpolated(rolled(f"SELECT g.series, g.ts, d.value FROM ({GRID}) g LEFT JOIN ({DAILY}) d USING (series, ts)", 3, "NULL"))))
def regular(t):
    return rounded(ts.regularise(daily(t), "ts", ["series"]), ["value"], 7)


MONTH_GRID = f"""SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS ts FROM (SELECT series, min(ts) AS lo, max(ts) AS hi FROM ({MONTHLY}) GROUP BY 1)"""


@query("g4_fill_grid_monthly", f"SELECT g.series, g.ts, d.value FROM ({MONTH_GRID}) g LEFT JOIN ({MONTHLY}) d USING (series, ts)")
def month_grid(t):
    return ts.fill_grid(monthly(t), "ts", ["series"])


@query(
    "g4_fill_grid_hourly",
    """WITH e AS (SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2),
    g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM e GROUP BY 1))
    SELECT event_type, ts, n FROM g LEFT JOIN e USING (event_type, ts)""",
)
def hour_grid(t):
    e = t.events.groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("n"))
    return ts.fill_grid(e, "ts", ["event_type"], "H")


@query(
    "g5_resample_daily_ffill",
    """WITH e AS (SELECT event_type, ts, max(value) AS value FROM events GROUP BY 1, 2),
    g AS (SELECT event_type, unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi), INTERVAL 1 DAY))::TIMESTAMP AS ts FROM (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM e GROUP BY 1))
    SELECT g.event_type, g.ts, e.value FROM g ASOF LEFT JOIN e ON g.event_type = e.event_type AND g.ts >= e.ts""",
)
def resampled(t):
    e = t.events.groupBy("event_type", "ts").agg(F.max("value").alias("value"))
    return ts.resample_daily_ffill(e, "ts", ["event_type"])


@query(
    "g6_series_patterns",
    f"""WITH p AS (SELECT *, row_number() OVER w - 1 AS pos, lag(value, 7) OVER w AS l7, lag(value, 30) OVER w AS l30 FROM ({GAPPY_DAILY}) WINDOW w AS (PARTITION BY series ORDER BY ts)),
    f AS (SELECT series, count(*) AS length, count(*) - count(value) AS missing, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std,
      count(value) AS known, regr_slope(value, CASE WHEN value IS NOT NULL THEN pos END) AS slope, corr(value, l7) AS r7, corr(value, l30) AS r30 FROM p GROUP BY 1)
    SELECT series, length, missing, round(missing * 100.0 / length, 4) AS missing_percent, min, max, round(mean, 2) AS mean, round(std, 2) AS std,
      CASE WHEN abs(slope) < 0.01 THEN 'no_trend' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend,
      CASE WHEN known <= 24 THEN 'unknown' WHEN abs(r7) > 0.3 OR abs(r30) > 0.3 THEN 'likely_seasonal' ELSE 'likely_non_seasonal' END AS seasonality FROM f""",
)
def patterns(t):
    found = ts.series_patterns(gappy_daily(t), "ts", "value", ["series"])
    return rounded(rounded(found, ["missing_percent"]), ["mean", "std"], 2)


@query(
    "g7_series_advice",
    f"""SELECT series, count(*) AS rows, min(ts) AS start, max(ts) AS "end", 'univariate' AS forecasting_type, count(*) > 100 AS deep_learning_suitable, 12 AS seasonal_periods,
      CAST(least(12, floor(count(*) / 10)) AS INTEGER) AS horizon, CASE WHEN count(*) > 100 THEN 'NBEATS,LSTM,AutoARIMA' ELSE 'ExponentialSmoothing,NaiveSeasonal' END AS suggested_models
    FROM ({MONTHLY}) GROUP BY 1""",
)
def advice(t):
    return ts.series_advice(monthly(t), "ts", ["series"])


def untidy(t):
    """Daily values as texts, with a null token, a bad date and a spare column."""
    d = gappy_daily(t)
    day = F.dayofyear("ts")
    return d.select(
        "series",
        F.when(day == 200, F.lit("Unknown")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("when"),
        "value",
        F.when(day % 7 == 0, F.lit("Missing")).otherwise(F.concat(F.lit("1,"), F.lpad(day.cast("string"), 3, "0"))).alias("points"),
        F.lit("x").alias("spare"),
    )


UNTIDY = f"""SELECT series, ts, value, CASE WHEN dayofyear(ts) % 7 <> 0 THEN 1000.0::DOUBLE + dayofyear(ts) END AS points FROM ({GAPPY_DAILY}) WHERE dayofyear(ts) <> 200"""


@query(
    "g8_process_series",
    f"""WITH u AS ({UNTIDY}), i AS ({interpolated(rolled("SELECT series, ts, value FROM u", 3, "NULL"))}),
    b AS (SELECT i.series, i.ts, i.value, u.points FROM i JOIN u USING (series, ts) WHERE isodow(i.ts) < 6), m AS (SELECT quantile_cont(points, 0.5) AS m FROM b)
    SELECT series, ts AS "when", round(value, 7) AS value, round(coalesce(points, m), 7) AS points FROM b, m""",
)
def processed(t):
    done, _ = ts.process_series(untidy(t), "when", "B", ["spare"], "auto", ["series"])
    return rounded(done, ["value", "points"], 7)


@query(
    "g8_process_report",
    f"""WITH u AS ({UNTIDY})
    SELECT 1 AS step, 'rows read' AS text, count(*)::DOUBLE AS value FROM ({GAPPY_DAILY})
    UNION ALL SELECT 2, 'rows with a date', count(*) FROM u UNION ALL SELECT 3, 'columns dropped', 1
    UNION ALL SELECT 4, 'values missing before', count(*) - count(value) FROM u UNION ALL SELECT 5, 'columns made numeric', 1
    UNION ALL SELECT 6, 'rows written', count(*) FILTER (isodow(ts) < 6) FROM u""",
)
def process_report(t):
    return ts.process_series(untidy(t), "when", "B", ["spare"], "auto", ["series"])[1]


@query(
    "g9_chrono_split",
    f"""SELECT series, ts, value, row_number() OVER w - 1 AS _pos, CASE WHEN row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY series) * 0.8) THEN 'train' ELSE 'test' END AS part
    FROM ({DAILY}) WINDOW w AS (PARTITION BY series ORDER BY ts)""",
)
def split(t):
    return ts.chrono_split(daily(t), "ts", ["series"])
