"""Forecasting of panels.

Models work on regular series: `points` is (series, pos, ts, value) with
positions 0..n-1. A series is handed to a recurrence in blocks of BLOCK values,
so a series of any length is folded exactly and no row holds more than one
block. Additive recurrences reduce all blocks side by side (smoothing.py).
"""

from __future__ import annotations

import math
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabsmith.functions.columns import col, numeric_columns
from tabsmith.operators.gram import LinearFit, moments
from tabsmith.operators.ordered import POS, over_preceding, with_position
from tabsmith.operators.smoothing import BLOCK, Level, Season, Trend, smoothed
from tabsmith.operators.timeseries import chrono_split, detect_frequency, regularise
from tabsmith.session import materialise


def to_points(df: DataFrame, ts: str, value: str, by: str) -> DataFrame:
    """A regular panel as (series, pos, ts, value)."""
    base = df.select(col(by).alias("series"), col(ts).alias("ts"), col(value).cast("double").alias("value"))
    placed = over_preceding(base, ["series"], "ts", 0, lambda w: {})
    return placed.select("series", F.col(POS).alias("pos"), "ts", "value")


def lengths(points: DataFrame) -> DataFrame:
    return points.groupBy("series").agg((F.max("pos") + 1).alias("n"))


def horizons(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(horizon)))


# --- metrics ---------------------------------------------------------------------

def forecast_metrics(df: DataFrame, keys: list[str], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """Smape, mape, mae and rmse per group; a group without finite
    metrics is marked failed."""
    y, p = col(actual), col(forecast)
    sound = ~(F.isnan(p) | (F.abs(p) == float("inf")))
    flagged = df.filter(y.isNotNull())
    base = flagged.groupBy(*keys).agg(
        (200 * F.avg(F.abs(y - p) / F.nullif(F.abs(y) + F.abs(p), F.lit(0.0)))).alias("smape"),
        (100 * F.avg(F.abs((y - p) / F.nullif(y, F.lit(0.0))))).alias("mape"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.count(F.when(p.isNull() | ~sound, 1)).alias("_bad"),
    )
    failed = (F.col("_bad") > 0) | F.col("smape").isNull() | F.col("mae").isNull()
    return base.select(
        *keys,
        F.when(failed, "failed").otherwise("success").alias("status"),
        *[F.when(~failed, F.col(m)).alias(m) for m in ("smape", "mape", "mae", "rmse")],
    )


# --- folds -----------------------------------------------------------------------

def fold_points(points: DataFrame, block: int, start: Column, step, grid: Column | None = None) -> DataFrame:
    """Run a recurrence over each series; returns (series, p, state).

    `start(values)` builds the first state from the first block that has values,
    `step(state, x)` advances it by one struct (pos, value). `grid` is an array of parameter
    structs; each is tried for every series and reaches `start` and `step` as
    the column `p`. Blocks follow one another; a lineage of many blocks is cut
    by writing the states.
    """
    cell = F.struct("pos", "value")
    blocks = points.filter(F.col("value").isNotNull()).groupBy("series", F.floor(F.col("pos") / block).alias("b")).agg(
        F.array_sort(F.collect_list(cell)).alias("xs")
    )
    count = (points.agg(F.max("pos").alias("m")).first()["m"] or 0) // block + 1
    options = grid if grid is not None else F.array(F.struct(F.lit(0).alias("none")))
    own = blocks.withColumn("own", F.min("b").over(W.partitionBy("series")))
    if count > 1:
        own = materialise(own, "blocks")
    first = own.filter("b = own").select("series", "xs", F.explode(options).alias("p"))
    state = first.select("series", "p", F.aggregate("xs", start(F.col("xs"), F.col("p")), lambda s, x: step(s, x, F.col("p"))).alias("s"))
    for b in range(1, count):
        following = own.filter((F.col("b") == b) & (F.col("own") < b)).select(F.col("series").alias("_k"), "xs")
        joined = state.join(following, F.col("series").eqNullSafe(F.col("_k")), "left")
        moved = F.aggregate("xs", F.col("s"), lambda s, x: step(s, x, F.col("p")))
        state = joined.select("series", "p", F.when(F.col("xs").isNull(), F.col("s")).otherwise(moved).alias("s"))
        if b % 8 == 0:
            state = materialise(state, "states")
    return state


def best_fit(states: DataFrame) -> DataFrame:
    """Parameters with the least squared one-step error per series."""
    return states.groupBy("series").agg(F.min_by(F.struct("p", "s"), F.struct("s.sse", "p")).alias("m")).select(
        "series", "m.p", "m.s"
    )


def _grid(**axes) -> Column:
    cells = [[]]
    for name, values in axes.items():
        cells = [c + [(name, v)] for c in cells for v in values]
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in c]) for c in cells])


ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]
COARSE = [0.1, 0.3, 0.5, 0.7, 0.9]
TRENDS = [0.01, 0.05, 0.1, 0.3, 0.5]
SEASONS = [0.05, 0.1, 0.3, 0.5]


def _d(x) -> Column:
    return F.lit(float(x))


def ses(points: DataFrame, horizon: int, block: int = BLOCK) -> DataFrame:
    """Simple exponential smoothing; flat forecast of the last level."""
    fitted = smoothed(points, Level(ALPHAS), block=block)
    return fitted.select("series", horizons(horizon).alias("h"), F.get("state", F.lit(0)).alias("forecast"))


def holt(points: DataFrame, horizon: int, block: int = BLOCK) -> DataFrame:
    """Level and additive trend."""
    fitted = smoothed(points, Trend(COARSE, TRENDS), block=block).select("series", "state", horizons(horizon).alias("h"))
    return fitted.select("series", "h", (F.get("state", F.lit(0)) + F.col("h") * F.get("state", F.lit(1))).alias("forecast"))


def holt_winters(
    points: DataFrame, horizon: int, period: int = 12, seasonal: str = "add", block: int = BLOCK, trend: str = "add"
) -> DataFrame:
    """Level, trend and a seasonal cycle, each of the last two additive or
    multiplicative. Series shorter than two cycles get no forecast.

    The additive kind is an associative scan over blocks. What is
    multiplicative is not affine in the state, so its blocks are folded one
    after another.
    """
    if block < 2 * period:
        raise ValueError("a block has to hold two cycles")
    mul, grows = seasonal == "mul", trend == "mul"
    if not mul and not grows:
        fitted = smoothed(points, Season(period, COARSE, TRENDS, SEASONS), block=block).select("series", "state", horizons(horizon).alias("h"))
        ahead = F.get("state", F.lit(0)) + F.col("h") * F.get("state", F.lit(1))
        return fitted.select("series", "h", (ahead + F.get("state", 2 + F.pmod(F.col("h") - 1, F.lit(period)))).alias("forecast"))

    def mean_of(xs):
        return F.aggregate(xs, _d(0), lambda a, x: a + x["value"]) / period

    def start(xs, p):
        one, two = mean_of(F.slice(xs, 1, period)), mean_of(F.slice(xs, period + 1, period))
        cycle = F.transform(F.slice(xs, 1, period), lambda x: x["value"] / one if mul else x["value"] - one)
        return F.struct(
            one.alias("level"), (F.pow(two / one, _d(1 / period)) if grows else (two - one) / period).alias("trend"), cycle.alias("cycle"), _d(0).alias("sse"), _d(0).alias("seen")
        )

    def step(s, x, p):
        season = F.get(s["cycle"], F.lit(0))
        ahead = s["level"] * s["trend"] if grows else s["level"] + s["trend"]
        expected = ahead * season if mul else ahead + season
        error = x["value"] - expected
        bare = x["value"] / season if mul else x["value"] - season
        level = p["alpha"] * bare + (1 - p["alpha"]) * ahead
        change = level / s["level"] if grows else level - s["level"]
        slope = p["beta"] * change + (1 - p["beta"]) * s["trend"]
        fresh = p["gamma"] * (x["value"] / level if mul else x["value"] - level) + (1 - p["gamma"]) * season
        turned = F.concat(F.slice(s["cycle"], 2, period - 1), F.array(fresh))
        warm = s["seen"] < period  # the first cycle made the start
        return F.struct(
            F.when(warm, s["level"]).otherwise(level).alias("level"),
            F.when(warm, s["trend"]).otherwise(slope).alias("trend"),
            F.when(warm, s["cycle"]).otherwise(turned).alias("cycle"),
            F.when(warm, s["sse"]).otherwise(s["sse"] + error * error).alias("sse"),
            (s["seen"] + 1).alias("seen"),
        )

    states = fold_points(points, block, start, step, _grid(alpha=COARSE, beta=TRENDS, gamma=SEASONS))
    fitted = best_fit(states.filter(F.col("s.seen") >= 2 * period))
    season = F.get("s.cycle", F.pmod(F.col("h") - 1, F.lit(period)))
    base = F.col("s.level") + F.col("h") * F.col("s.trend")
    if grows:
        base = F.col("s.level") * F.pow(F.col("s.trend"), F.col("h").cast("double"))
    value = base * season if mul else base + season
    return fitted.select("series", "s", horizons(horizon).alias("h")).select("series", "h", value.alias("forecast"))


def line_of(points: DataFrame) -> DataFrame:
    """Least-squares line per series: (series, n, slope, intercept)."""
    x = F.col("pos").cast("double")
    return points.filter(F.col("value").isNotNull()).groupBy("series").agg(
        (F.max("pos") + 1).alias("n"), F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("intercept")
    )


def theta(points: DataFrame, horizon: int, block: int = BLOCK) -> DataFrame:
    """Mean of the trend line and the smoothed line with doubled curvature."""
    line = line_of(points)
    keyed = points.alias("l").join(line.alias("r"), F.col("l.series").eqNullSafe(F.col("r.series")))
    bent = keyed.select(
        "l.series", "l.pos", "l.ts", (2 * F.col("l.value") - (F.col("r.intercept") + F.col("r.slope") * F.col("l.pos"))).alias("value")
    )
    smooth = ses(bent, horizon, block)
    both = smooth.alias("l").join(line.alias("r"), F.col("l.series").eqNullSafe(F.col("r.series")))
    trend = F.col("r.intercept") + F.col("r.slope") * (F.col("r.n") - 1 + F.col("l.h"))
    return both.select("l.series", "l.h", (0.5 * trend + 0.5 * F.col("l.forecast")).alias("forecast"))


CROSTON_ALPHA = 0.1


def croston(points: DataFrame, horizon: int, block: int = BLOCK) -> DataFrame:
    """Smoothed demand size over smoothed interval; zero without demand.

    Only values with demand move the state, so they are cut out with their
    distance from the one before and smoothed as two columns side by side.
    """
    known = points.filter(F.col("value").isNotNull()).select("series", "pos", "value")
    hits = with_position(known, ["series"], "pos").filter("value != 0").select("series", F.col(POS).alias("at"), "value")
    # The first demand comes after as many values as stand before it, itself among them.
    gaps = over_preceding(hits, ["series"], "at", 1, lambda w: {"gap": F.col("at") - F.coalesce(F.lag("at").over(w), F.lit(-1))})
    demand = gaps.select("series", F.col(POS).alias("pos"), "value", F.col("gap").cast("double").alias("gap"))
    fitted = smoothed(demand, Level([CROSTON_ALPHA], 2), ["value", "gap"], block)
    rate = fitted.select(F.col("series").alias("_k"), (F.get("state", F.lit(0)) / F.get("state", F.lit(1))).alias("rate"))
    every = known.select("series").distinct().join(rate, F.col("series").eqNullSafe(F.col("_k")), "left")
    return every.select("series", horizons(horizon).alias("h"), F.coalesce("rate", _d(0)).alias("forecast"))


# --- naive and frequency models -----------------------------------------------------

def naive_seasonal(points: DataFrame, horizon: int, period: int = 12) -> DataFrame:
    """Repeat the last `period` values."""
    n = lengths(points)
    tail = points.alias("l").join(n.alias("r"), F.col("l.series").eqNullSafe(F.col("r.series")))
    back = F.least(F.lit(period), F.col("r.n"))
    slot = F.col("l.pos") - (F.col("r.n") - back)
    last = tail.filter(slot >= 0).select("l.series", "l.value", slot.alias("slot"), back.alias("k"))
    reached = last.filter(F.col("slot") < horizon)
    steps = F.explode(F.sequence((F.col("slot") + 1).cast("int"), F.lit(horizon), F.col("k").cast("int")))
    return reached.select("series", steps.alias("h"), F.col("value").alias("forecast"))


def naive_last(points: DataFrame, horizon: int) -> DataFrame:
    """Repeat the last value."""
    return naive_seasonal(points, horizon, 1)


def naive_drift(points: DataFrame, horizon: int) -> DataFrame:
    """The last value plus the mean change per step."""
    ends = points.groupBy("series").agg(
        F.min_by("value", "pos").alias("a"), F.max_by("value", "pos").alias("b"), (F.max("pos") + 1).alias("n")
    )
    step = F.try_divide(F.col("b") - F.col("a"), F.col("n") - 1)
    return ends.select("*", horizons(horizon).alias("h")).select(
        "series", "h", (F.col("b") + F.coalesce(step, _d(0)) * F.col("h")).alias("forecast")
    )


def dft_forecast(points: DataFrame, horizon: int, keep: int = 10) -> DataFrame:
    """Keep the strongest frequencies of each series and run on.

    The whole spectrum is ranked, so a real wave counts twice; equal strengths
    are taken from the lowest frequency.
    """
    spectrum = _spectrum(points.filter(F.col("value").isNotNull()).select("series", "pos", "value"))
    strength = F.round(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 6)
    place = F.row_number().over(W.partitionBy("series").orderBy(F.desc("strength"), "k"))
    # The rank limit is applied in every task before rows are moved.
    top = spectrum.withColumn("strength", strength).withColumn("place", place).filter(F.col("place") <= keep)
    turn = 2 * math.pi * F.pmod(F.col("k") * F.pmod(F.col("h") - 1, F.col("n")), F.col("n")) / F.col("n")
    wave = (F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn)) / F.col("n")
    return top.select("*", horizons(horizon).alias("h")).groupBy("series", "h").agg(F.sum(wave).alias("forecast"))


def _pass(df: DataFrame, group: str, place: str, size: str, inverse: bool, turned: bool) -> DataFrame:
    """Transform the column of each group, as long as its column `size` says;
    `turned` then turns the result by its place in the whole."""
    kind = df.schema["series"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        length, bits = int(pdf[size].iloc[0]), int(pdf["bits"].iloc[0])
        held = np.zeros(length, complex)
        held[pdf[place].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        out = np.fft.ifft(held) * length if inverse else np.fft.fft(held)
        k, g = np.arange(length), int(pdf[group].iloc[0])
        if turned:
            out = out * np.exp((2j if inverse else -2j) * np.pi * (k * g % 2**bits) / 2**bits)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "g": g, "k": k, "re": out.real, "im": out.imag, "bits": bits})

    return df.groupBy("series", group).applyInPandas(run, f"series {kind}, g bigint, k bigint, re double, im double, bits int")


def _fft(df: DataFrame, inverse: bool = False) -> DataFrame:
    """Transform of (series, j, re, im, bits), each series of its own length
    2**bits, in two grouped passes over columns and rows; absent values are
    zero. No group is longer than about the root of its series."""
    sides = {"n1": F.expr("shiftleft(1L, bits div 2)"), "n2": F.expr("shiftleft(1L, bits - bits div 2)")}
    cut = df.withColumns(sides)
    cut = cut.withColumns({"j1": F.floor(F.col("j") / F.col("n2")), "j2": F.pmod("j", "n2")})
    first = _pass(cut, "j2", "j1", "n1", inverse, True)
    across = first.select("series", F.col("k").alias("k1"), F.col("g").alias("j2"), "re", "im", "bits").withColumns(sides)
    second = _pass(across, "k1", "j2", "n2", inverse, False).withColumns(sides)
    return second.select("series", (F.col("g") + F.col("n1") * F.col("k")).alias("j"), "re", "im", "bits")


def _spectrum(points: DataFrame) -> DataFrame:
    """(series, n, k, re, im): the spectrum of series of any length, as a
    convolution with a chirp so that only transforms of a power of two are needed."""
    n = points.groupBy("series").agg(F.count("*").alias("n")).withColumn("bits", F.ceil(F.log2(2 * F.col("n"))).cast("int"))
    keyed = points.alias("l").join(n.alias("r"), F.col("l.series").eqNullSafe(F.col("r.series")))
    base = keyed.select("l.series", F.col("l.pos").alias("j"), "l.value", "r.n", "r.bits")
    angle = lambda j: math.pi * F.pmod(F.col(j) * F.col(j), 2 * F.col("n")) / F.col("n")
    a = base.select(
        "series", "j", (F.col("value") * F.cos(angle("j"))).alias("re"), (-F.col("value") * F.sin(angle("j"))).alias("im"), "bits"
    )
    whole = F.expr("shiftleft(1L, bits)")
    both_ends = F.explode(F.array_distinct(F.array(F.col("j"), F.pmod(-F.col("j"), whole))))
    chirp = base.select("series", both_ends.alias("at"), F.cos(angle("j")).alias("re"), F.sin(angle("j")).alias("im"), "bits")
    left = _fft(a).alias("l")
    right = _fft(chirp.withColumnRenamed("at", "j")).alias("r")
    on = F.col("l.series").eqNullSafe(F.col("r.series")) & (F.col("l.j") == F.col("r.j"))
    product = left.join(right, on).select(
        "l.series",
        "l.j",
        (F.col("l.re") * F.col("r.re") - F.col("l.im") * F.col("r.im")).alias("re"),
        (F.col("l.re") * F.col("r.im") + F.col("l.im") * F.col("r.re")).alias("im"),
        "l.bits",
    )
    back = _fft(product, inverse=True).alias("l")
    sized = back.join(n.alias("r"), F.col("l.series").eqNullSafe(F.col("r.series"))).filter(F.col("l.j") < F.col("r.n"))
    scale = F.expr("shiftleft(1L, l.bits)")
    rows = sized.select("l.series", "r.n", F.col("l.j").alias("k"), (F.col("l.re") / scale).alias("a"), (F.col("l.im") / scale).alias("b"))
    c, s = F.cos(angle("k")), F.sin(angle("k"))
    return rows.select(
        "series", "n", "k", (F.col("a") * c + F.col("b") * s).alias("re"), (F.col("b") * c - F.col("a") * s).alias("im")
    )


# --- regression on lags ---------------------------------------------------------------

# The most lags of any lag regression and of the light ones.
MOST_LAGS, LIGHT_LAGS = 24, 12


def lag_models(seed: int = 42) -> dict:
    """Names and settings of the lag regressions."""
    common = {"featuresCol": "x", "labelCol": "y", "predictionCol": "p"}
    return {
        "LinearRegression": LinearFit(),
        "Ridge": LinearFit(1.0),
        "Lasso": LinearFit(0.1, 1.0),
        "ElasticNet": LinearFit(0.1, 0.5),
        "RandomForest": RandomForestRegressor(numTrees=100, maxDepth=10, seed=seed, **common),
        "RandomForest_Light": RandomForestRegressor(numTrees=50, maxDepth=8, seed=seed, **common),
        "BoostedTrees": GBTRegressor(maxIter=100, maxDepth=6, stepSize=0.1, seed=seed, **common),
        "BoostedTrees_Light": GBTRegressor(maxIter=50, maxDepth=4, stepSize=0.15, seed=seed, **common),
    }


COVARIATE_LAGS = [1, 2, 3, 6, 12]


def _linear_steps(weights: np.ndarray):
    """Adds `preds`, a step ahead per row of weights, as plain expressions."""
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])

    def advance(state: DataFrame) -> DataFrame:
        x = F.concat(F.array(F.lit(1.0)), "hist", "extra")
        dot = lambda row: F.aggregate(F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return state.withColumn("preds", F.transform(rows, dot))

    return advance


def _model_steps(models: list):
    """Adds `preds`, a step ahead per fitted model."""

    def advance(state: DataFrame) -> DataFrame:
        state = state.withColumn("x", array_to_vector(F.concat("hist", "extra")))
        for i, model in enumerate(models):
            state = model.setPredictionCol(f"p{i}").transform(state)
        return state.withColumn("preds", F.array(*[F.col(f"p{i}") for i in range(len(models))]))

    return advance


def lag_regression(
    points: DataFrame,
    horizon: int,
    estimator,
    lags: int | None = None,
    chunk: int = 12,
    covariates: list[str] = (),
    chunk_rows: int | None = None,
    most: int = MOST_LAGS,
) -> DataFrame:
    """A direct model per step ahead, pooled over all series.

    Steps 1..chunk have a model each, trained on all windows of all series: the
    linear ones all at once from one Gram matrix of the windows, others one by
    one over written windows. Beyond the chunk, predictions become history and
    the same models go on.
    `covariates` are further numeric columns of `points` whose lags join the
    features; they are known for the past only, so such a model goes no further
    than one chunk.
    """
    shortest = lengths(points).agg(F.min("n").alias("n")).first()["n"]
    lags = lags or min(most, max(1, min(MOST_LAGS, shortest // 3)))
    chunk = min(chunk, horizon) if not covariates else horizon
    span = lags + chunk

    def windows(w):
        cols = {"_w": F.collect_list("value").over(w.rowsBetween(-(span - 1), 0))}
        cols["_h"] = F.collect_list("value").over(w.rowsBetween(-(lags - 1), 0))
        for c in covariates:
            for k in COVARIATE_LAGS:
                cols[f"_c_{c}_{k}"] = F.lag(col(c), k - 1 + chunk).over(w)
                cols[f"_n_{c}_{k}"] = F.lag(col(c), k - 1).over(w)
        return cols

    reach = max(span - 1, max(COVARIATE_LAGS) - 1 + chunk if covariates else 0)
    known = points.filter(F.col("value").isNotNull())
    seen = over_preceding(known.drop(POS), ["series"], "pos", reach, windows, chunk_rows)
    past = [f"_c_{c}_{k}" for c in covariates for k in COVARIATE_LAGS]
    now = [f"_n_{c}_{k}" for c in covariates for k in COVARIATE_LAGS]
    full = seen.filter(F.size("_w") == span)
    for c in past:
        full = full.filter(col(c).isNotNull())
    features = F.concat(F.slice("_w", 1, lags), F.array(*[col(c).cast("double") for c in past]).cast("array<double>"))
    targets = F.slice("_w", lags + 1, chunk)
    if isinstance(estimator, LinearFit):
        middle = known.agg(F.avg("value"), *[F.avg(col(c)) for c in covariates]).first()
        shift = [middle[0]] * lags + [m or 0.0 for m in middle[1:] for _ in COVARIATE_LAGS] + [middle[0]] * chunk
        found = moments(full.select(F.concat(features, targets).alias("z")), "z", shift)
        advance = _linear_steps(estimator.solve(found, lags + len(past)))
    else:
        train = materialise(full.select(array_to_vector(features).alias("x"), targets.alias("ys")), "windows")
        fit = lambda i: estimator.copy().fit(train.select("x", F.get("ys", F.lit(i)).alias("y")))
        with ThreadPool(4) as pool:
            models = pool.map(inheritable_thread_target(points.sparkSession)(fit), range(chunk), chunksize=1)
        advance = _model_steps(models)
    last = seen.filter(F.size("_h") == lags).groupBy("series").agg(
        F.max_by(F.struct("_h", *[col(c) for c in now]), "pos").alias("m")
    ).select("series", "m.*")
    extra = F.array(*[F.coalesce(col(c).cast("double"), _d(0)) for c in now]).cast("array<double>")
    state = last.select("series", F.col("_h").alias("hist"), extra.alias("extra"), F.array().cast("array<double>").alias("done"))
    for turn in range(math.ceil(horizon / chunk)):
        if turn % 4 == 3:  # one row per series; keeps the plan of a long horizon short
            state = materialise(state, "rolled")
        state = advance(state)
        joined = F.concat("hist", "preds")
        state = state.select("series", F.slice(joined, -lags, lags).alias("hist"), "extra", F.concat("done", "preds").alias("done"))
    listed = state.select("series", F.posexplode("done").alias("i", "forecast")).filter(F.col("i") < horizon)
    return listed.select("series", (F.col("i") + 1).alias("h"), "forecast")


# --- training, forecasting, ranking -----------------------------------------------------

def statistical_models(period: int = 12) -> dict:
    """Names. Name to forecaster `(points, horizon) -> (series, h, forecast)`."""
    return {
        "NaiveSeasonal": lambda p, h: naive_seasonal(p, h, period),
        "NaiveLast": naive_last,
        "NaiveDrift": naive_drift,
        "ExponentialSmoothing": ses,
        "Holt": holt,
        "HoltWinters": lambda p, h: holt_winters(p, h, period, "add"),
        "ExponentialSmoothing_Mul": lambda p, h: holt_winters(p, h, period, "mul", trend="mul"),
        "Theta": theta,
        "Croston": croston,
        "FFT": lambda p, h: dft_forecast(p, h, 10),
    }


def model_catalogue(period: int = 12, statistical: bool = True, learned: bool = True) -> dict:
    found = statistical_models(period) if statistical else {}
    if learned:
        for name, estimator in lag_models().items():
            most = LIGHT_LAGS if name.endswith("_Light") else MOST_LAGS
            found[name] = lambda p, h, e=estimator, m=most: lag_regression(p, h, e, most=m)
    return found


def split_points(panel: DataFrame, ts: str, value: str, by: str, train: float = 0.8) -> tuple[DataFrame, DataFrame, int]:
    """Training points, test rows (series, h, actual) and the longest test part."""
    base = panel.select(col(by).alias("series"), col(ts).alias("ts"), col(value).cast("double").alias("value"))
    parts = materialise(chrono_split(base, "ts", ["series"], train), "split")
    points = parts.filter("part = 'train'").select("series", F.col(POS).alias("pos"), "ts", "value")
    n = lengths(points)
    held = parts.filter("part = 'test'").alias("l").join(n.alias("r"), F.col("l.series").eqNullSafe(F.col("r.series")))
    test = held.select("l.series", (F.col(f"l.{POS}") - F.col("r.n") + 1).cast("int").alias("h"), F.col("l.value").alias("actual"))
    return points, test, test.agg(F.max("h").alias("h")).first()["h"]


def evaluate(points: DataFrame, test: DataFrame, horizon: int, models: dict) -> DataFrame:
    """Metrics per (series, model). A model that cannot be fitted gives failed
    rows that carry its error; the others go on."""
    series = test.select("series").distinct()
    parts = []
    for name, model in models.items():
        try:
            predicted = model(points, horizon)
            joined = test.alias("l").join(
                predicted.alias("r"), F.col("l.series").eqNullSafe(F.col("r.series")) & (F.col("l.h") == F.col("r.h")), "left"
            )
            scored = forecast_metrics(joined.select("l.series", F.lit(name).alias("model"), "l.actual", "r.forecast"), ["series", "model"])
            # Written here, so that a model that fails while it runs fails alone.
            parts.append(materialise(scored.withColumn("error", F.when(F.col("status") == "failed", "no finite forecast")), "metrics"))
        except (PySparkException, Py4JJavaError, ValueError, ArithmeticError) as problem:
            none = F.lit(None).cast("double")
            parts.append(
                series.select(
                    "series", F.lit(name).alias("model"), F.lit("failed").alias("status"),
                    *[none.alias(m) for m in ("smape", "mape", "mae", "rmse")], F.lit(str(problem).splitlines()[0][:200] if str(problem) else type(problem).__name__).alias("error"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def ts_leaderboard(results: DataFrame) -> DataFrame:
    """Models ranked by smape within a series, failed ones last.

    `r2_like` repeats a rough conversion some clients read; it is no R2.
    """
    order = W.partitionBy("series").orderBy(F.col("status") == "failed", F.col("smape").asc_nulls_last(), "model")
    share = F.col("smape") / 100
    return results.select(
        "*", F.greatest(_d(0), 1 - share * share).alias("r2_like"), F.row_number().over(order).alias("rank")
    )


def unpivot_panel(df: DataFrame, ts: str, columns: list[str] | None = None) -> DataFrame:
    """Every numeric column becomes a series named after it."""
    columns = columns or [c for c in numeric_columns(df) if c != ts]
    cells = F.array(*[F.struct(F.lit(c).alias("series"), col(c).cast("double").alias("value")) for c in columns])
    return df.select(col(ts).alias("ts"), F.explode(cells).alias("c")).select("c.series", "ts", "c.value")


def panel_train(
    df: DataFrame, ts: str, columns: list[str] | None = None, models: dict | None = None, train: float = 0.8, freq: str | None = None
) -> DataFrame:
    """Regularise, split, fit and rank every model for every column."""
    panel = regularise(unpivot_panel(df, ts, columns), "ts", ["series"], freq, ["value"])
    points, test, horizon = split_points(panel, "ts", "value", "series", train)
    return ts_leaderboard(evaluate(points, test, horizon, models or model_catalogue()))


def future_times(panel: DataFrame, ts: str, by: str, horizon: int) -> DataFrame:
    """(series, h, ts): the next timestamps on the detected frequency; one day
    apart where none is detected."""
    found = detect_frequency(panel, ts, [by])
    last = panel.groupBy(col(by)).agg(F.max(col(ts).cast("timestamp")).alias("last"))
    both = last.alias("l").join(found.alias("r"), F.col(f"l.`{by}`").eqNullSafe(F.col(f"r.`{by}`")))
    spread = both.select(F.col(f"l.`{by}`").alias("series"), "l.last", "r.frequency", horizons(horizon).alias("h"))
    count = F.coalesce(F.regexp_extract("frequency", r"^(\d+)", 1).try_cast("int"), F.lit(1)) * F.col("h")
    unit = F.coalesce(F.nullif(F.regexp_extract("frequency", r"([A-Z])$", 1), F.lit("")), F.lit("D"))
    at_end = F.last_day("last") == F.to_date("last")
    clock = F.unix_micros("last") - F.unix_micros(F.date_trunc("day", "last"))

    def months(step):
        moved = F.add_months(F.to_date("last"), (count * step).cast("int"))
        day = F.when(at_end, F.last_day(moved)).otherwise(moved)
        return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + clock)

    weekday = F.weekday("last")
    # Business days: whole weeks of five, then skip the weekend if it is crossed.
    from_friday = F.least(weekday, F.lit(4))
    target = from_friday + F.col("h")
    business = F.floor(target / 5) * 7 + target % 5 - weekday
    ts_next = (
        F.when(unit == "B", F.col("last") + F.make_interval(days=business.cast("int")))
        .when(unit == "W", F.col("last") + F.make_interval(days=count * 7))
        .when(unit == "M", months(1))
        .when(unit == "Q", months(3))
        .when(unit == "A", months(12))
        .when(unit == "H", F.col("last") + F.make_interval(hours=count))
        .when(unit == "T", F.col("last") + F.make_interval(mins=count))
        .when(unit == "S", F.col("last") + F.make_interval(secs=count))
        .otherwise(F.col("last") + F.make_interval(days=count))
    )
    return spread.select("series", "h", ts_next.alias("ts"))


def forecast(panel: DataFrame, ts: str, value: str, by: str, model, horizon: int) -> DataFrame:
    """Refit on all rows and give the future values with their times."""
    predicted = model(to_points(panel, ts, value, by), horizon)
    times = future_times(panel, ts, by, horizon)
    on = F.col("l.series").eqNullSafe(F.col("r.series")) & (F.col("l.h") == F.col("r.h"))
    return times.alias("l").join(predicted.alias("r"), on).select("l.series", "l.h", "l.ts", "r.forecast")
