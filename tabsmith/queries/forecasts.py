"""Queries for forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import forecast as fc
from tabsmith.queries.fixtures import DAILY, MONTHLY, daily, monthly
from tabsmith.queries.profiling import rounded
from tabsmith.queries.registry import query


def points(t):
    return fc.to_points(monthly(t), "ts", "value", "series")


POINTS = f"SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos, ts, value FROM ({MONTHLY})"
LAST = f"SELECT *, count(*) OVER (PARTITION BY series) AS n FROM ({POINTS})"


def seasonal_sql(source: str, k: int, horizon: int) -> str:
    return f"""SELECT p.series, CAST(h AS INTEGER) AS h, p.value AS forecast FROM ({source}) p, range(1, {horizon + 1}) AS r(h)
      WHERE p.pos >= p.n - {k} AND p.pos - (p.n - {k}) = (h - 1) % {k}"""


def test_sql(source: str) -> str:
    return f"""SELECT series, CAST(pos - floor(n * 0.8) + 1 AS INTEGER) AS h, value AS actual FROM ({source}) WHERE pos >= floor(n * 0.8)"""


TRAIN = f"SELECT series, pos, ts, value, CAST(floor(n * 0.8) AS BIGINT) AS n FROM ({LAST}) WHERE pos < floor(n * 0.8)"
METRICS = """200 * avg(abs(actual - forecast) / nullif(abs(actual) + abs(forecast), 0)) AS smape, 100 * avg(abs((actual - forecast) / nullif(actual, 0))) AS mape,
  avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse"""
DRIFT = f"""SELECT series, CAST(h AS INTEGER) AS h, b + (b - a) / (n - 1) * h AS forecast FROM (SELECT series, arg_min(value, pos) AS a, arg_max(value, pos) AS b, any_value(n) AS n FROM ({{}}) GROUP BY 1), range(1, {{}}) AS r(h)"""
NAIVE = f"""SELECT 'NaiveSeasonal' AS model, * FROM ({seasonal_sql(TRAIN, 12, 40)}) UNION ALL SELECT 'NaiveLast', * FROM ({seasonal_sql(TRAIN, 1, 40)})
  UNION ALL SELECT 'NaiveDrift', * FROM ({DRIFT.format(TRAIN, 41)})"""
BOARD = f"""SELECT series, model, {METRICS} FROM ({test_sql(LAST)}) t JOIN ({NAIVE}) f USING (series, h) GROUP BY 1, 2"""
NAMES = ["NaiveSeasonal", "NaiveLast", "NaiveDrift"]
SCORES = ["smape", "mape", "mae", "rmse"]


def evaluated(t):
    train, test, horizon = fc.split_points(monthly(t), "ts", "value", "series")
    every = fc.statistical_models()
    return fc.evaluate(train, test, horizon, {n: every[n] for n in NAMES})


@query("g10_forecast_metrics", f"SELECT series, model, 'success' AS status, round(smape, 4) AS smape, round(mape, 4) AS mape, round(mae, 6) AS mae, round(rmse, 4) AS rmse FROM ({BOARD})")
def metrics(t):
    return rounded(rounded(evaluated(t).drop("error"), ["smape", "mape", "rmse"]), ["mae"], 6)


@query("g11_naive_seasonal", seasonal_sql(LAST, 12, 18))
def seasonal(t):
    return fc.naive_seasonal(points(t), 18, 12)


@query("g11_naive_last", seasonal_sql(LAST, 1, 6))
def last(t):
    return fc.naive_last(points(t), 6)


@query("g11_naive_drift", f"SELECT series, h, round(forecast, 2) AS forecast FROM ({DRIFT.format(LAST, 7)})")
def drift(t):
    return rounded(fc.naive_drift(points(t), 6), ["forecast"], 2)


def recursive_ses(source: str) -> str:
    """Simple smoothing over the same alphas, as a recursive query."""
    return f"""WITH RECURSIVE p AS ({source}), a AS (SELECT i * 0.05 AS alpha FROM range(1, 20) AS r(i)),
    f(series, alpha, pos, level, sse) AS (
      SELECT series, alpha, pos, value, 0.0::DOUBLE FROM p, a WHERE pos = 0
      UNION ALL SELECT f.series, f.alpha, p.pos, f.level + f.alpha * (p.value - f.level), f.sse + (p.value - f.level) * (p.value - f.level) FROM f JOIN p ON p.series = f.series AND p.pos = f.pos + 1),
    e AS (SELECT f.* FROM f JOIN (SELECT series, max(pos) AS m FROM p GROUP BY 1) x ON x.series = f.series AND x.m = f.pos)
    SELECT series, arg_min(level, (sse, alpha)) AS level FROM e GROUP BY 1"""


@query("g12_ses", f"SELECT series, CAST(h AS INTEGER) AS h, round(level, 2) AS forecast FROM ({recursive_ses(POINTS)}), range(1, 7) AS r(h)")
def smoothing(t):
    return rounded(fc.ses(points(t), 6), ["forecast"], 2)


@query("g12_ses_blocks", f"SELECT series, CAST(h AS INTEGER) AS h, round(level, 2) AS forecast FROM ({recursive_ses(POINTS)}), range(1, 7) AS r(h)")
def smoothing_blocks(t):
    """The same with series folded in several blocks, as long ones are."""
    return rounded(fc.ses(points(t), 6, block=30), ["forecast"], 2)


def holt_sql(source: str, horizon: int) -> str:
    """Level and trend over the same settings, as a recursive query: (series, h, forecast)."""
    return f"""WITH RECURSIVE p AS MATERIALIZED ({source}), a AS (SELECT alpha, beta FROM unnest({fc.COARSE}::DOUBLE[]) AS x(alpha), unnest({fc.TRENDS}::DOUBLE[]) AS y(beta)),
    f(series, alpha, beta, pos, level, trend, sse) AS (
      SELECT p.series, alpha, beta, 0, p.value, coalesce(q.value - p.value, 0), 0.0::DOUBLE FROM (SELECT * FROM p WHERE pos = 0) p LEFT JOIN (SELECT * FROM p WHERE pos = 1) q ON q.series = p.series, a
      UNION ALL SELECT series, alpha, beta, pos + 1, level + trend + alpha * e, trend + alpha * beta * e, sse + e * e
        FROM (SELECT f.*, p.value - (level + trend) AS e FROM f JOIN p ON p.series = f.series AND p.pos = f.pos + 1)),
    e AS (SELECT f.* FROM f JOIN (SELECT series, max(pos) AS m FROM p GROUP BY 1) x ON x.series = f.series AND x.m = f.pos)
    SELECT series, CAST(h AS INTEGER) AS h, b.level + h * b.trend AS forecast FROM (SELECT series, arg_min({{'level': level, 'trend': trend}}, (sse, alpha, beta)) AS b FROM e GROUP BY 1), range(1, {horizon + 1}) AS r(h)"""


def winters_sql(source: str, m: int, horizon: int, mul: bool) -> str:
    """Level, trend and cycle over the same settings, as a recursive query: (series, h, forecast)."""
    part, joined, bare = ("/", "*", "x / s") if mul else ("-", "+", "x - s")
    axes = zip(("alpha", "beta", "gamma"), (fc.COARSE, fc.TRENDS, fc.SEASONS))
    return f"""WITH RECURSIVE p AS MATERIALIZED ({source}), a AS (SELECT * FROM {", ".join(f"unnest({v}::DOUBLE[]) AS {n}({n})" for n, v in axes)}),
    base AS (SELECT series, avg(value) FILTER (pos < {m}) AS one, avg(value) FILTER (pos >= {m} AND pos < {2 * m}) AS two, list(value ORDER BY pos) FILTER (pos < {m}) AS firsts
      FROM p GROUP BY 1 HAVING count(*) >= {2 * m}),
    f(series, alpha, beta, gamma, pos, level, trend, cycle, sse) AS (
      SELECT series, alpha, beta, gamma, {m - 1}, one, (two - one) / {m}, list_transform(firsts, lambda v: v {part} one), 0.0::DOUBLE FROM base, a
      UNION ALL SELECT series, alpha, beta, gamma, pos + 1, l, beta * (l - level) + (1 - beta) * trend, cycle[2:] || [gamma * (x {part} l) + (1 - gamma) * s], sse + e * e FROM (
        SELECT *, alpha * ({bare}) + (1 - alpha) * ahead AS l, x - (ahead {joined} s) AS e FROM (
          SELECT f.*, p.value AS x, f.cycle[1] AS s, level + trend AS ahead FROM f JOIN p ON p.series = f.series AND p.pos = f.pos + 1))),
    e AS (SELECT f.* FROM f JOIN (SELECT series, max(pos) AS m FROM p GROUP BY 1) x ON x.series = f.series AND x.m = f.pos)
    SELECT series, CAST(h AS INTEGER) AS h, (b.level + h * b.trend) {joined} b.cycle[(h - 1) % {m} + 1] AS forecast
    FROM (SELECT series, arg_min({{'level': level, 'trend': trend, 'cycle': cycle}}, (sse, alpha, beta, gamma)) AS b FROM e GROUP BY 1), range(1, {horizon + 1}) AS r(h)"""


def in_cents(sql: str) -> str:
    return f"SELECT series, h, round(forecast, 2) AS forecast FROM ({sql})"


@query("g12_holt", in_cents(holt_sql(POINTS, 6)))
def holt(t):
    return rounded(fc.holt(points(t), 6), ["forecast"], 2)


@query("g12_holt_blocks", in_cents(holt_sql(POINTS, 6)))
def holt_blocks(t):
    """The same with series reduced in many blocks that are joined in a tree."""
    return rounded(fc.holt(points(t), 6, block=3), ["forecast"], 2)


@query("g12_holt_winters_add", in_cents(winters_sql(POINTS, 12, 12, False)))
def winters(t):
    return rounded(fc.holt_winters(points(t), 12, 12, "add"), ["forecast"], 2)


@query("g12_holt_winters_add_blocks", in_cents(winters_sql(POINTS, 12, 12, False)))
def winters_blocks(t):
    """The same with series reduced in several blocks, as long ones are."""
    return rounded(fc.holt_winters(points(t), 12, 12, "add", block=25), ["forecast"], 2)


@query("g12_holt_winters_mul", in_cents(winters_sql(POINTS, 12, 12, True)))
def winters_mul(t):
    return rounded(fc.holt_winters(points(t), 12, 12, "mul"), ["forecast"], 2)


BENT = f"SELECT p.series, p.pos, 2 * p.value - (a + b * p.pos) AS value FROM ({POINTS}) p JOIN (SELECT series, regr_intercept(value, pos) AS a, regr_slope(value, pos) AS b FROM ({POINTS}) GROUP BY 1) l USING (series)"


@query(
    "g13_theta",
    f"""SELECT l.series, CAST(h AS INTEGER) AS h, round(0.5 * (a + b * (n - 1 + h)) + 0.5 * level, 1) AS forecast
    FROM (SELECT series, regr_intercept(value, pos) AS a, regr_slope(value, pos) AS b, count(*) AS n FROM ({POINTS}) GROUP BY 1) l JOIN ({recursive_ses(BENT)}) s ON s.series = l.series, range(1, 7) AS r(h)""",
)
def theta(t):
    return rounded(fc.theta(points(t), 6), ["forecast"], 1)


def intermittent(t):
    """Daily counts of urgent orders above a price: many zero days."""
    big = t.orders.groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts")).agg(
        F.sum((F.col("o_totalprice") > 250000).cast("double")).alias("value")
    )
    return fc.to_points(big, "ts", "value", "series")


@query(
    "g14_croston",
    """WITH RECURSIVE d AS (SELECT o_orderpriority AS series, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS pos, sum(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END)::DOUBLE AS value
      FROM orders GROUP BY o_orderpriority, o_orderdate),
    q AS (SELECT series, value, pos - coalesce(lag(pos) OVER w, -1) AS gap, row_number() OVER w AS i FROM d WHERE value <> 0 WINDOW w AS (PARTITION BY series ORDER BY pos)),
    f(series, i, size, gap) AS (SELECT series, i, value, gap::DOUBLE FROM q WHERE i = 1
      UNION ALL SELECT f.series, q.i, f.size + 0.1 * (q.value - f.size), f.gap + 0.1 * (q.gap - f.gap) FROM f JOIN q ON q.series = f.series AND q.i = f.i + 1)
    SELECT f.series, CAST(h AS INTEGER) AS h, round(size / gap, 4) AS forecast FROM f JOIN (SELECT series, max(i) AS m FROM q GROUP BY 1) x ON x.series = f.series AND x.m = f.i, range(1, 4) AS r(h)""",
)
def croston(t):
    return rounded(fc.croston(intermittent(t), 3), ["forecast"])


FOURIER = f"""WITH p AS ({LAST}), k AS (SELECT p.series, p.n, j.j, sum(p.value * cos(-2 * pi() * j.j * p.pos / p.n)) AS re, sum(p.value * sin(-2 * pi() * j.j * p.pos / p.n)) AS im
        FROM p, range(0, 200) AS j(j) WHERE j.j < p.n GROUP BY 1, 2, 3),
    s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(sqrt(re * re + im * im), 3) DESC, j) AS rn FROM k)
    SELECT series, CAST(h AS INTEGER) AS h, round(sum(re * cos(2 * pi() * j * ((n + h - 1) % n) / n) - im * sin(2 * pi() * j * ((n + h - 1) % n) / n)) / any_value(n), 1) AS forecast
    FROM s, range(1, 13) AS r(h) WHERE rn <= 10 GROUP BY series, h"""


@query("g15_dft_forecast", FOURIER)
def fourier(t):
    return rounded(fc.dft_forecast(points(t), 12, 10), ["forecast"], 1)


@query("g15_dft_forecast_spread", FOURIER)
def fourier_spread(t):
    """The same with the transform spread over tasks, as for long series."""
    return rounded(fc.dft_forecast(points(t).repartition("pos"), 12, 10), ["forecast"], 1)


def ridge_sql(windows: str, last: str, lags: int, features: int, chunk: int, horizon: int, alpha: float) -> str:
    """Normal equations by elimination over a list of lists, then steps ahead that feed on themselves.

    `windows` gives z (features, then the next `chunk` values); `last` gives
    (series, x): the features to start from, the first `lags` of them history.
    """
    p, q = features, features + chunk
    return f"""WITH RECURSIVE w AS MATERIALIZED ({windows}),
    mu AS MATERIALIZED (SELECT i, avg(z[i]) AS m FROM w, range(1, {q + 1}) AS r(i) GROUP BY i),
    cell AS (SELECT a.i AS i, b.i AS j, sum((z[a.i] - a.m) * (z[b.i] - b.m)) + CASE WHEN a.i = b.i THEN {alpha} ELSE 0 END AS v FROM w, mu a, mu b WHERE a.i <= {p} GROUP BY 1, 2),
    g(k, mat) AS (
      SELECT 1, list(v ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS v FROM cell GROUP BY i)
      UNION ALL SELECT k + 1, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {q + 1}), lambda j:
        CASE WHEN i = k THEN mat[k][j] / mat[k][k] ELSE mat[i][j] - mat[i][k] / mat[k][k] * mat[k][j] END)) FROM g WHERE k <= {p}),
    fit AS MATERIALIZED (SELECT mat, (SELECT list(m ORDER BY i) FROM mu) AS m FROM g WHERE k = {p + 1}),
    f(series, turn, x, done) AS (
      SELECT series, 0, x, []::DOUBLE[] FROM ({last})
      UNION ALL SELECT series, turn + 1, (x[1:{lags}] || preds)[-{lags}:] || x[{lags + 1}:], done || preds FROM (
        SELECT f.*, list_transform(range({p + 1}, {q + 1}), lambda t: m[t] + list_sum(list_transform(range(1, {p + 1}), lambda i: (x[i] - m[i]) * mat[i][t]))) AS preds
        FROM f, fit WHERE len(done) < {horizon}))
    SELECT series, CAST(h AS INTEGER) AS h, round(done[h], 1) AS forecast FROM f, range(1, {horizon + 1}) AS r(h) WHERE len(done) >= {horizon}"""


def lagged(source: str, lags: int, chunk: int) -> tuple[str, str]:
    """Windows of `lags` and `chunk` values, and the last `lags` values of each series."""
    over = "OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    windows = f"SELECT z FROM (SELECT list(value) {over.format(lags + chunk - 1)} AS z FROM ({source})) WHERE len(z) = {lags + chunk}"
    last = f"SELECT series, list(value ORDER BY pos)[-{lags}:] AS x FROM ({source}) GROUP BY series"
    return windows, last


@query("g16_lag_regression_linear", ridge_sql(*lagged(POINTS, 12, 6), 12, 12, 6, 15, 1.0))
def lag_linear(t):
    return rounded(fc.lag_regression(points(t), 15, fc.lag_models()["Ridge"], lags=12, chunk=6), ["forecast"], 1)


@query("g16_lag_regression_least_squares", ridge_sql(*lagged(POINTS, 6, 3), 6, 6, 3, 7, 0.0))
def lag_least_squares(t):
    return rounded(fc.lag_regression(points(t), 7, fc.lag_models()["LinearRegression"], lags=6, chunk=3), ["forecast"], 1)


@query(
    "g16_lag_regression_one",
    f"""WITH RECURSIVE w AS (SELECT series, pos, value AS y, lag(value) OVER (PARTITION BY series ORDER BY pos) AS x FROM ({POINTS})),
    l AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM w),
    f(series, h, forecast) AS (SELECT series, 0, arg_max(value, pos) FROM ({POINTS}) GROUP BY series UNION ALL SELECT series, h + 1, a + b * forecast FROM f, l WHERE h < 5)
    SELECT series, CAST(h AS INTEGER) AS h, round(forecast, 1) AS forecast FROM f WHERE h > 0""",
)
def lag_one(t):
    """One lag: the line that SQL has aggregates for."""
    return rounded(fc.lag_regression(points(t), 5, fc.lag_models()["LinearRegression"], lags=1, chunk=1), ["forecast"], 1)


@query("g16_lag_regression_forest")
def lag_forest(t):
    return rounded(fc.lag_regression(points(t), 4, fc.lag_models()["RandomForest_Light"], lags=12, chunk=2), ["forecast"], 1)


PANEL = """SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS ts, round(sum(o_totalprice), 2) AS value, count(*)::DOUBLE AS orders FROM orders GROUP BY 1, 2"""
PAST = ", ".join(f"lag(orders, {k} - 1 + 3) OVER v AS p{k}, coalesce(lag(orders, {k} - 1) OVER v, 0) AS n{k}" for k in (1, 2, 3, 6, 12))
SEEN = f"""SELECT series, pos, list(value) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS z, {PAST}
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos FROM ({PANEL})) WINDOW v AS (PARTITION BY series ORDER BY pos)"""


@query(
    "g17_exogenous_regression",
    ridge_sql(
        f"SELECT z[1:6] || [p1, p2, p3, p6, p12] || z[7:9] AS z FROM ({SEEN}) WHERE len(z) = 9 AND p12 IS NOT NULL",
        f"SELECT series, arg_max(z[-6:] || [n1, n2, n3, n6, n12], pos) AS x FROM ({SEEN}) GROUP BY series",
        6, 11, 3, 3, 0.0,
    ),
)
def exogenous(t):
    panel = t.orders.groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").alias("ts")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").cast("double").alias("orders")
    )
    known = panel.groupBy("series", "ts").agg(F.max("orders").alias("orders"))
    pts = fc.to_points(panel, "ts", "value", "series").alias("l")
    joined = pts.join(known.alias("r"), (F.col("l.series") == F.col("r.series")) & (F.col("l.ts") == F.col("r.ts")))
    frame = joined.select("l.series", "l.pos", "l.ts", "l.value", "r.orders")
    return rounded(fc.lag_regression(frame, 3, fc.lag_models()["LinearRegression"], lags=6, covariates=["orders"]), ["forecast"], 1)


@query("g18_panel_train")
def panel(t):
    wide = t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("ts")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count("*").cast("double").alias("orders")
    )
    models = {n: m for n, m in fc.statistical_models().items() if n in ("NaiveSeasonal", "NaiveLast", "Holt", "Theta", "Croston")}
    models["Ridge"] = lambda p, h: fc.lag_regression(p, h, fc.lag_models()["Ridge"], chunk=4)
    return rounded(fc.panel_train(wide, "ts", models=models), ["smape", "mape", "mae", "rmse", "r2_like"])


@query(
    "g19_forecast",
    f"""SELECT f.series, f.h, CAST(l.last + to_months(f.h) AS TIMESTAMP) AS ts, f.forecast FROM ({seasonal_sql(LAST, 12, 12)}) f JOIN (SELECT series, max(ts) AS last FROM ({MONTHLY}) GROUP BY 1) l USING (series)""",
)
def future(t):
    return fc.forecast(monthly(t), "ts", "value", "series", lambda p, h: fc.naive_seasonal(p, h, 12), 12)


@query(
    "g19_forecast_daily",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM ({DAILY}))
    SELECT f.series, f.h, CAST(l.last + to_days(f.h) AS TIMESTAMP) AS ts, f.forecast FROM ({seasonal_sql("SELECT * FROM p", 7, 14)}) f JOIN (SELECT series, max(ts) AS last FROM p GROUP BY 1) l USING (series)""",
)
def future_daily(t):
    return fc.forecast(daily(t), "ts", "value", "series", lambda p, h: fc.naive_seasonal(p, h, 7), 14)


@query(
    "g20_ts_leaderboard",
    f"""SELECT series, model, 'success' AS status, round(smape, 4) AS smape, round(mape, 4) AS mape, round(mae, 6) AS mae, round(rmse, 4) AS rmse,
      round(greatest(0, 1 - (smape / 100) * (smape / 100)), 4) AS r2_like, CAST(row_number() OVER (PARTITION BY series ORDER BY smape, model) AS INTEGER) AS rank FROM ({BOARD})""",
)
def board(t):
    ranked = fc.ts_leaderboard(evaluated(t).drop("error"))
    return rounded(rounded(ranked, ["smape", "mape", "r2_like", "rmse"]), ["mae"], 6)
