"""Forecasters against plain loops; blocks give what one pass gives."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import forecast as fc
from tabsmith.operators import timeseries as ts
from tabsmith.operators.gram import LinearFit, Moments, moments

START = dt.datetime(2020, 1, 1)


def series(n=60, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return {
        "up": 100 + 2.0 * t + 10 * np.sin(t * 2 * np.pi / 12) + rng.normal(size=n),
        "flat": 50 + rng.normal(size=n) * 3,
    }


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, i, START + dt.timedelta(days=i), float(v)) for k, vs in series().items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series string, pos bigint, ts timestamp, value double").repartition(3).cache()


def forecasts(df, name):
    return [r["forecast"] for r in df.filter(F.col("series") == name).orderBy("h").collect()]


def plain_ses(y):
    best = None
    for a in fc.ALPHAS:
        level, sse = y[0], 0.0
        for v in y[1:]:
            sse += (v - level) ** 2
            level += a * (v - level)
        best = min(best, (sse, a, level)) if best else (sse, a, level)
    return best[2]


def plain_holt(y, h):
    best = None
    for a, b in itertools.product(fc.COARSE, fc.TRENDS):
        level, trend, sse = y[0], y[1] - y[0], 0.0
        for v in y[1:]:
            e = v - level - trend
            level, trend, sse = level + trend + a * e, trend + a * b * e, sse + e * e
        found = (sse, a, b, level, trend)
        best = min(best, found) if best else found
    return [best[3] + k * best[4] for k in range(1, h + 1)]


def plain_winters(y, h, m, mul):
    best = None
    for a, b, g in itertools.product(fc.COARSE, fc.TRENDS, fc.SEASONS):
        level = np.mean(y[:m])
        trend = (np.mean(y[m : 2 * m]) - level) / m
        cycle = [v / level if mul else v - level for v in y[:m]]
        sse = 0.0
        for v in y[m:]:
            s = cycle.pop(0)
            expected = (level + trend) * s if mul else level + trend + s
            sse += (v - expected) ** 2
            new = a * (v / s if mul else v - s) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            level = new
            cycle.append(g * (v / level if mul else v - level) + (1 - g) * s)
        found = (sse, a, b, g, level, trend, cycle)
        best = min(best, found, key=lambda f: f[:4]) if best else found
    level, trend, cycle = best[4:]
    return [((level + k * trend) * cycle[(k - 1) % m] if mul else level + k * trend + cycle[(k - 1) % m]) for k in range(1, h + 1)]


@pytest.mark.parametrize("block", [1000, 25, 2])
def test_smoothing(points, block):
    for name, y in series().items():
        assert np.allclose(forecasts(fc.ses(points, 3, block), name), plain_ses(y))
        assert np.allclose(forecasts(fc.holt(points, 4, block), name), plain_holt(y, 4))


@pytest.mark.parametrize("block,kind", [(1000, "add"), (24, "add"), (25, "mul")])
def test_seasonal_smoothing(points, block, kind):
    got = fc.holt_winters(points, 14, 12, kind, block)
    for name, y in series().items():
        assert np.allclose(forecasts(got, name), plain_winters(list(y), 14, 12, kind == "mul"))


def test_short_series_gets_no_seasonal_forecast(points):
    assert fc.holt_winters(points.filter("pos < 20"), 3, 12).count() == 0


def test_theta(points):
    y = series()["up"]
    t = np.arange(len(y))
    b, a = np.polyfit(t, y, 1)
    bent = plain_ses(2 * y - (a + b * t))
    assert np.allclose(forecasts(fc.theta(points, 2), "up"), [0.5 * (a + b * (len(y) - 1 + h)) + 0.5 * bent for h in (1, 2)])


def test_croston(spark):
    y = [0, 0, 3, 0, 5, 0, 0, 2, 0]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)] + [("none", i, 0.0) for i in range(4)], "series string, pos bigint, value double")
    size, gap = 3.0, 3.0
    for v, w in ((5, 2), (2, 3)):
        size, gap = size + 0.1 * (v - size), gap + 0.1 * (w - gap)
    for block in (100, 2):
        got = fc.croston(df, 1, block)
        assert np.allclose(forecasts(got, "a"), [size / gap]) and forecasts(got, "none") == [0.0]


def test_fourier_repeats_a_pure_wave(spark):
    y = 5 + np.sin(np.arange(48) * 2 * np.pi / 12)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "series string, pos bigint, value double")
    assert np.allclose(forecasts(fc.dft_forecast(df, 24, 3), "a"), y[:24], atol=1e-6)


def test_spread_fourier_equals_numpy(spark):
    rng = np.random.default_rng(8)
    series = {name: rng.normal(size=n) for name, n in (("a", 61), ("b", 48), (None, 7))}
    rows = [(name, i, float(v)) for name, y in series.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series string, pos bigint, value double")
    got = {(r["series"], r["h"]): r["forecast"] for r in fc.dft_forecast(df, 5, 6).collect()}
    assert len(got) == 15
    for name, y in series.items():
        found = np.fft.fft(y)
        top = np.lexsort((np.arange(len(y)), -np.round(np.abs(found), 6)))[:6]
        kept = np.zeros(len(y), complex)
        kept[top] = found[top]
        wave = np.fft.ifft(kept).real
        assert np.allclose([got[name, h] for h in range(1, 6)], [wave[(h - 1) % len(y)] for h in range(1, 6)], atol=1e-8)


def test_multiplicative_trend_by_hand(spark):
    y = [(10 + i % 3) * 1.02**i for i in range(24)]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "series string, pos bigint, value double")
    got = forecasts(fc.holt_winters(df, 6, 3, "mul", trend="mul"), "a")
    assert np.allclose(got, [(10 + (24 + h) % 3) * 1.02 ** (24 + h) for h in range(6)], rtol=0.05)


def test_first_block_without_values(spark):
    rows = [("a", i, None if i < 12 else float(i)) for i in range(30)] + [("b", i, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "series string, pos bigint, value double")
    late = df.filter("series = 'a' and value is not null").selectExpr("series", "pos - 12 as pos", "value")
    assert np.allclose(forecasts(fc.ses(df, 2, block=10), "a"), forecasts(fc.ses(late, 2), "a"))


def test_light_models_take_twelve_lags(spark):
    names = fc.model_catalogue(statistical=False)
    y = [float(i % 5) for i in range(90)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "series string, pos bigint, value double")
    seen = []

    class Spy:
        def copy(self):
            return self

        def fit(self, rows):
            seen.append(rows.first()["x"].size)
            raise ValueError("seen")

    for most in (24, 12):
        with pytest.raises(ValueError):
            fc.lag_regression(df, 1, Spy(), most=most).collect()
    assert seen == [24, 12] and "RandomForest_Light" in names


def test_failing_model_fails_alone(spark):
    from pyspark.sql import functions as F

    rows = [("a", i, float(i % 4), "train" if i < 16 else "test") for i in range(20)]
    df = spark.createDataFrame(rows, "series string, pos bigint, value double, part string")
    points = df.filter("part = 'train'").drop("part")
    test = df.filter("part = 'test'").select("series", (F.col("pos") - 15).cast("int").alias("h"), F.col("value").alias("actual"))
    broken = lambda p, h: fc.naive_last(p, h).withColumn("forecast", F.raise_error(F.lit("at run time")).cast("double"))
    got = {r["model"]: r for r in fc.ts_leaderboard(fc.evaluate(points, test, 4, {"broken": broken, "last": fc.naive_last})).collect()}
    assert got["last"]["status"] == "success" and got["last"]["rank"] == 1
    assert got["broken"]["status"] == "failed" and "at run time" in got["broken"]["error"]


def test_naive(points):
    y = series()["flat"]
    assert forecasts(fc.naive_seasonal(points, 15, 12), "flat") == [*y[-12:], *y[-12:-9]]
    assert forecasts(fc.naive_last(points, 2), "flat") == [y[-1]] * 2
    assert np.allclose(forecasts(fc.naive_drift(points, 2), "flat"), [y[-1] + (y[-1] - y[0]) / 59 * h for h in (1, 2)])


@pytest.mark.parametrize("chunk_rows", [None, 40])
def test_lag_regression_learns_a_recurrence(spark, chunk_rows):
    rows = []
    for name, (a, b) in {"x": (1.0, 2.0), "y": (3.0, 1.0)}.items():
        y = [a, b]
        while len(y) < 60:
            y.append(1.6 * y[-1] - 0.9 * y[-2] + 0.5)
        rows += [(name, i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series string, pos bigint, value double")
    got = fc.lag_regression(df.filter("pos < 50"), 8, fc.lag_models()["LinearRegression"], lags=3, chunk=2, chunk_rows=chunk_rows)
    for name in ("x", "y"):
        want = [r["value"] for r in df.filter(f"series = '{name}' and pos between 50 and 57").orderBy("pos").collect()]
        assert np.allclose(forecasts(got, name), want, atol=1e-2)


def plain_lines(z, p, alpha, l1, sweeps=4000):
    """Weights of every target by plain coordinate descent over the rows."""
    x, y = z[:, :p] - z[:, :p].mean(axis=0), z[:, p:] - z[:, p:].mean(axis=0)
    n, out = len(z), []
    for t in y.T:
        w = np.zeros(p)
        for _ in range(sweeps):
            for j in range(p):
                free = x[:, j] @ (t - x @ w + x[:, j] * w[j]) / n
                cut = np.sign(free) * max(abs(free) - alpha * l1, 0)
                w[j] = cut / (x[:, j] @ x[:, j] / n + alpha * (1 - l1))
        out.append(w)
    return np.array(out)


def test_lines_from_one_gram_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * [1, 3, 8, 0.5] + [0, 100, -5, 1e6]
    x[:, 3] += x[:, 0]
    z = np.concatenate([x, (x @ [1, -2, 0, 0.5] + rng.normal(size=300))[:, None], (x @ [0, 0, 0.3, 0])[:, None]], axis=1)
    rows = [([float(v) for v in r],) for r in z] + [([1.0],), ([None] * 6,), ([float("nan")] * 6,), (None,)]
    got = moments(spark.createDataFrame(rows, "z array<double>").repartition(7), "z", [0.0, 90.0, 0.0, 1e6, 5e5, 0.0])
    assert got.n == 300 and np.allclose(got.mean, z.mean(axis=0)) and np.allclose(got.cross, np.cov(z.T) * 299, rtol=1e-8)
    for fit, alpha, l1 in ((LinearFit(0.1, 1.0), 0.1, 1.0), (LinearFit(0.1, 0.5), 0.1, 0.5), (LinearFit(1.0), 1 / 300, 0.0)):
        lines = fit.solve(got, 4)
        assert np.allclose(lines[:, 1:], plain_lines(z, 4, alpha, l1), atol=1e-6)
        assert np.allclose(lines[:, 0] + lines[:, 1:] @ z[:, :4].mean(axis=0), z[:, 4:].mean(axis=0))
    best, *_ = np.linalg.lstsq(np.c_[np.ones(300), z[:, :4] - z[:, :4].mean(axis=0)], z[:, 4:], rcond=None)
    assert np.allclose(LinearFit().solve(got, 4)[:, 1:], best[1:].T, atol=1e-6)
    assert np.count_nonzero(LinearFit(50.0, 1.0).solve(got, 4)[:, 1:]) < 4


def test_equal_columns_and_no_rows(spark):
    rows = [([float(i), float(i), 7.0, 3.0 * i],) for i in range(20)]
    got = moments(spark.createDataFrame(rows, "z array<double>"), "z", [0.0] * 4)
    assert np.allclose(LinearFit().solve(got, 3), [[0, 1.5, 1.5, 0]])
    none = moments(spark.createDataFrame([], "z array<double>"), "z", [0.0] * 4)
    with pytest.raises(ValueError, match="no rows"):
        LinearFit().solve(none, 3)


@pytest.mark.parametrize("name", ["Lasso", "ElasticNet"])
def test_lasso_forecasts_are_the_best_ones(spark, points, name):
    """No weight can be moved to a better value, and the steps ahead are those of the weights."""
    fit, lags, chunk, horizon = fc.lag_models()[name], 5, 2, 7
    z = np.array([y[i : i + lags + chunk] for y in series().values() for i in range(len(y) - lags - chunk + 1)])
    centred = z - z.mean(axis=0)
    lines = fit.solve(Moments(len(z), z.mean(axis=0), centred.T @ centred), lags)
    for line, target in zip(lines, centred[:, lags:].T):
        w = line[1:]
        slope = centred[:, :lags].T @ (target - centred[:, :lags] @ w) / len(z) - fit.alpha * (1 - fit.l1) * w
        assert np.allclose(slope[w != 0], fit.alpha * fit.l1 * np.sign(w[w != 0]), atol=1e-7)
        assert (np.abs(slope[w == 0]) <= fit.alpha * fit.l1 + 1e-7).all()
    got = fc.lag_regression(points, horizon, fit, lags=lags, chunk=chunk)
    for key, y in series().items():
        past = list(y)
        while len(past) < len(y) + horizon:
            past += list(lines[:, 0] + lines[:, 1:] @ past[-lags:])
        assert np.allclose(forecasts(got, key), past[len(y) : len(y) + horizon], rtol=1e-6)


def test_covariates_help(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=120)
    y = np.concatenate([[0], 3 * x[:-1]])  # yesterday's covariate decides
    rows = [("a", i, float(v), float(c)) for i, (v, c) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "series string, pos bigint, value double, x double")
    model = fc.lag_models()["LinearRegression"]
    known = df.filter("pos < 119")
    with_x = forecasts(fc.lag_regression(known, 1, model, lags=2, covariates=["x"]), "a")[0]
    assert abs(with_x - y[119]) < 1e-6 < abs(forecasts(fc.lag_regression(known, 1, model, lags=2), "a")[0] - y[119])


def test_failed_models_are_listed(spark, points):
    panel = points.select("series", "ts", "value")
    train, test, horizon = fc.split_points(panel, "ts", "value", "series")
    assert horizon == 12

    def broken(p, h):
        raise ValueError("no luck")

    results = fc.evaluate(train, test, horizon, {"NaiveLast": fc.naive_last, "Broken": broken, "Empty": lambda p, h: fc.naive_last(p, h).filter("h < 0")})
    board = fc.ts_leaderboard(results).filter("series = 'up'").orderBy("rank").collect()
    assert [r["model"] for r in board] == ["NaiveLast", "Broken", "Empty"]
    assert [r["status"] for r in board] == ["success", "failed", "failed"] and board[1]["error"] == "no luck"


def test_frequencies(spark):
    def days(*values):
        return [START + dt.timedelta(days=v) for v in values]

    cases = {
        "daily": (days(0, 1, 2, 3, 4, 5, 6, 7), "D"),
        "second day": (days(0, 2, 4, 6), "2D"),
        "gaps": (days(0, 1, 2, 3, 4, 9, 10, 11, 20), "D"),
        "gaps at weekends": (days(0, 1, 2, 5, 6, 7, 12, 13), "B"),
        "work": ([d for d in days(*range(5, 40)) if d.weekday() < 5], "B"),
        "weekly": (days(0, 7, 14, 21), "W"),
        "hourly": ([START + dt.timedelta(hours=h) for h in range(5)], "H"),
        "six hours": ([START + dt.timedelta(hours=6 * h) for h in range(5)], "6H"),
        "month end": ([d.to_pydatetime() for d in pd.date_range("2020-01-31", periods=8, freq="ME")], "M"),
        "quarter": ([d.to_pydatetime() for d in pd.date_range("2020-03-31", periods=8, freq="QE")], "Q"),
        "year": ([d.to_pydatetime() for d in pd.date_range("2020-12-31", periods=4, freq="YE")], "A"),
        "odd": (days(0, 3, 20, 100), None),
        "single": (days(4), None),
    }
    rows = [(k, t) for k, (times, _) in cases.items() for t in times + times[:1]]
    df = spark.createDataFrame(rows, "series string, ts timestamp")
    got = {r["series"]: r["frequency"] for r in ts.detect_frequency(df, "ts", ["series"]).collect()}
    assert got == {k: f for k, (_, f) in cases.items()}


@pytest.mark.parametrize("freq,alias", [("D", "D"), ("B", "B"), ("W", "W"), ("M", "ME"), ("Q", "QE"), ("A", "YE"), ("H", "h")])
def test_as_frequency_like_pandas(spark, freq, alias):
    rng = np.random.default_rng(4)
    times = pd.date_range("2019-02-02 16:00", periods=900, freq="D")
    if freq == "H":
        times = pd.date_range("2019-02-02 16:30", periods=400, freq="30min")
    kept = sorted(rng.choice(len(times), int(len(times) * 0.7), replace=False))
    pdf = pd.DataFrame({"ts": times[kept], "v": np.arange(len(kept), dtype=float)})
    want = pdf.set_index("ts").asfreq(alias).dropna(how="all").reset_index()
    got = ts.as_frequency(spark.createDataFrame(pdf), "ts", freq).orderBy("ts").toPandas()
    assert list(got["ts"]) == list(want["ts"]) and list(got["v"]) == list(want["v"])


def test_future_times(spark):
    ends = {"B": dt.datetime(2024, 1, 4), "M": dt.datetime(2024, 1, 31, 16), "H": dt.datetime(2024, 1, 1, 22), "W": dt.datetime(2024, 1, 7)}
    alias = {"B": "B", "M": "ME", "H": "h", "W": "W"}
    rows = [(f, t.to_pydatetime()) for f, e in ends.items() for t in pd.date_range(end=e, periods=12, freq=alias[f])]
    got = fc.future_times(spark.createDataFrame(rows, "s string, ts timestamp"), "ts", "s", 4)
    for f, e in ends.items():
        want = [t.to_pydatetime() for t in pd.date_range(start=e, periods=5, freq=alias[f])[1:]]
        assert [r["ts"] for r in got.filter(F.col("series") == f).orderBy("h").collect()] == want


def test_split_limits(spark):
    short = spark.createDataFrame([("a", START + dt.timedelta(days=i), 1.0) for i in range(15)], "s string, ts timestamp, v double")
    with pytest.raises(ValueError):
        ts.chrono_split(short, "ts", ["s"])
    with pytest.raises(ValueError):
        ts.chrono_split(short, "ts", ["s"], 0.95)
