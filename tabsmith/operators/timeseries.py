"""Time-series preparation (G1-G9). Panels are long: series keys, time, values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabsmith.functions.columns import col, date_columns, finite, normalise_floats, numeric_columns, select_with
from tabsmith.operators.clean import (
    SERIES_NULL_TOKENS,
    blank_to_null,
    drop_columns,
    drop_empty_rows,
    inf_to_null_fill,
    null_tokens,
    numeric_if_mostly,
)
from tabsmith.operators.dates import smart_parse
from tabsmith.operators.impute import impute_auto_ts, impute_by_config
from tabsmith.operators.ordered import POS, neighbours, over_preceding, with_position
from tabsmith.session import materialise

# Frequency codes.
FREQUENCIES = {
    "D": "calendar day",
    "B": "business day",
    "W": "week, on Sunday",
    "M": "month end",
    "Q": "quarter end",
    "A": "year end",
    "H": "hour",
    "T": "minute",
    "S": "second",
}
SECONDS = {"H": 3600, "T": 60, "S": 1}

# Suggestions by length.
LONG_MODELS = ["NBEATS", "LSTM", "AutoARIMA"]
SHORT_MODELS = ["ExponentialSmoothing", "NaiveSeasonal"]
MULTIVARIATE_MODEL = "VARIMA"


def _on(by: list[str], left: str, right: str) -> Column:
    tests = [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in by]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _time_of_day(c: Column) -> Column:
    return F.unix_micros(c) - F.unix_micros(F.date_trunc("day", c))


def on_grid(ts: Column, start: Column, freq: str) -> Column:
    """Is `ts` a point of the grid that begins at or after `start`?

    Day-like grids keep the time of day of the first timestamp.
    """
    if freq in SECONDS:
        return F.pmod(F.unix_micros(ts) - F.unix_micros(start), F.lit(SECONDS[freq] * 1_000_000)) == 0
    ends = F.last_day(ts) == F.to_date(ts)
    day = {
        "D": F.lit(True),
        "B": F.weekday(ts) < 5,
        "W": F.weekday(ts) == 6,
        "M": ends,
        "Q": ends & (F.month(ts) % 3 == 0),
        "A": ends & (F.month(ts) == 12),
    }
    if freq not in day:
        raise ValueError(f"unknown frequency {freq!r}; known are {', '.join(FREQUENCIES)}")
    return day[freq] & (_time_of_day(ts) == _time_of_day(start))


def as_timestamps(df: DataFrame, ts: str) -> DataFrame:
    return select_with(df, {ts: col(ts).cast("timestamp")})


def as_frequency(df: DataFrame, ts: str, freq: str, by=()) -> DataFrame:
    """G1: keep the rows on the grid and drop rows without values.

    Missing grid points would be empty rows and go again, so no grid is built:
    whether a row lies on it follows from the first timestamp alone.
    """
    by = list(by)
    df = as_timestamps(df, ts)
    first = df.groupBy(*[col(c) for c in by]).agg(F.min(col(ts)).alias("_start"))
    if by:
        joined = df.alias("l").join(first.alias("r"), _on(by, "l", "r"))
        kept = joined.filter(on_grid(F.col(f"l.`{ts}`"), F.col("r._start"), freq)).select("l.*")
    else:
        start = first.first()["_start"]
        kept = df.filter(on_grid(col(ts), F.lit(start), freq))
    values = [c for c in df.columns if c != ts and c not in by]
    some = F.coalesce(*[F.when(col(c).isNotNull(), F.lit(True)) for c in values], F.lit(False))
    return kept.filter(some)


def dedupe_timestamps(df: DataFrame, ts: str, by=(), columns: list[str] | None = None) -> DataFrame:
    """One row per timestamp, numeric columns averaged (merged map-side)."""
    by = list(by)
    columns = columns or [c for c in numeric_columns(df) if c != ts and c not in by]
    return df.groupBy(*[col(c) for c in by], col(ts)).agg(*[F.avg(col(c)).alias(c) for c in columns])


def detect_frequency(df: DataFrame, ts: str, by=()) -> DataFrame:
    """(keys, frequency) per series; null when the spacing says nothing.

    One lag, one grouped count of gaps, and a reduction of the gap table.
    """
    by = list(by)
    keys = [col(c) for c in by]
    times = as_timestamps(df, ts).filter(col(ts).isNotNull()).select(*keys, col(ts)).distinct()

    def gaps(w):
        before = F.lag(col(ts), 1).over(w)
        months = 12 * (F.year(col(ts)) - F.year(before)) + F.month(col(ts)) - F.month(before)
        same_day = (F.dayofmonth(col(ts)) == F.dayofmonth(before)) & (_time_of_day(col(ts)) == _time_of_day(before))
        both_ends = (F.last_day(col(ts)) == F.to_date(col(ts))) & (F.last_day(before) == F.to_date(before))
        return {
            "_gap": ((F.unix_micros(col(ts)) - F.unix_micros(before)) / 1e6),
            "_months": F.when(same_day | both_ends, months),
        }

    steps = over_preceding(times, by, ts, 1, gaps)
    per_gap = steps.groupBy(*keys, "_gap", "_months").agg(
        F.count("*").alias("n"), F.max((F.weekday(col(ts)) >= 5).cast("int")).alias("weekend")
    )
    real = F.col("_gap").isNotNull()
    # Gaps that differ only in their month count are the same gap for the mode.
    by_gap = per_gap.groupBy(*keys, "_gap").agg(
        F.sum("n").alias("n"),
        F.max("weekend").alias("weekend"),
        F.min("_months").alias("mlo"),
        F.max("_months").alias("mhi"),
        F.min(F.col("_months").isNotNull()).alias("monthly"),
    )
    facts = by_gap.groupBy(*keys).agg(
        F.count(F.when(real, 1)).alias("kinds"),
        F.max("weekend").alias("weekend"),
        F.min_by(F.when(real, F.col("_gap")), F.when(real, F.struct(-F.col("n"), F.col("_gap")))).alias("mode"),
        F.min(F.when(real, F.col("mlo"))).alias("mlo"),
        F.max(F.when(real, F.col("mhi"))).alias("mhi"),
        F.min(F.when(real, F.col("monthly"))).alias("monthly"),
    )
    gap = F.col("mode")
    regular = (
        F.when(gap % 604800 == 0, _multiple(gap / 604800, "W"))
        .when(gap % 86400 == 0, _multiple(gap / 86400, "D"))
        .when(gap % 3600 == 0, _multiple(gap / 3600, "H"))
        .when(gap % 60 == 0, _multiple(gap / 60, "T"))
        .when(gap % 1 == 0, _multiple(gap, "S"))
    )
    calendar = F.when(
        F.col("monthly") & (F.col("mlo") == F.col("mhi")),
        F.when(F.col("mlo") == 1, "M").when(F.col("mlo") == 3, "Q").when(F.col("mlo") == 12, "A"),
    )
    days = F.floor(gap / 86400)
    common = (
        F.when(days == 1, F.when(F.col("weekend") == 1, "D").otherwise("B"))
        .when(days == 7, "W")
        .when(days.between(28, 31), "M")
    )
    label = F.when(F.col("kinds") == 0, F.lit(None)).otherwise(
        F.coalesce(calendar, F.when(F.col("kinds") == 1, regular), common)
    )
    return facts.select(*keys, label.alias("frequency"))


def _multiple(n: Column, unit: str) -> Column:
    return F.when(n == 1, F.lit(unit)).otherwise(F.concat(n.cast("bigint").cast("string"), F.lit(unit)))


def series_grid(df: DataFrame, ts: str, by=(), freq: str | None = None) -> DataFrame:
    """Grid points per series from its first to its last timestamp.

    With `freq` None the detected frequency of each series is used; series
    without one give no grid. Sub-day grids are exploded day by day, so no row
    holds more than a day of points.
    """
    by = list(by)
    keys = [col(c) for c in by]
    df = as_timestamps(df, ts)
    spans = df.filter(col(ts).isNotNull()).groupBy(*keys).agg(F.min(col(ts)).alias("_lo"), F.max(col(ts)).alias("_hi"))
    if freq is None:
        found = detect_frequency(df, ts, by)
        if by:
            spans = spans.alias("l").join(found.alias("r"), _on(by, "l", "r")).select("l.*", "r.frequency")
        else:
            spans = spans.withColumn("frequency", F.lit(found.first()["frequency"]))
    else:
        spans = spans.withColumn("frequency", F.lit(freq))
    lo, hi = F.col("_lo"), F.col("_hi")
    count = F.coalesce(F.regexp_extract("frequency", r"^(\d+)", 1).try_cast("int"), F.lit(1))
    unit = F.regexp_extract("frequency", r"([A-Z])$", 1)
    spans = spans.withColumns({"_n": count, "_u": unit})
    end_start = F.to_date(lo) == F.last_day(lo)
    clock = _time_of_day(lo)

    def months(step):
        base = F.sequence(F.trunc(F.to_date(lo), "month"), F.trunc(F.to_date(hi), "month"), F.make_interval(months=F.col("_n") * step))
        at_end = F.transform(base, lambda d: F.last_day(d))
        same = F.transform(base, lambda d: F.least(F.date_add(d, F.dayofmonth(lo) - 1), F.last_day(d)))
        dates = F.when(end_start, at_end).otherwise(same)
        return F.transform(dates, lambda d: F.timestamp_micros(F.unix_micros(d.cast("timestamp")) + clock))

    days = F.sequence(lo, hi, F.make_interval(days=F.col("_n")))
    coarse = (
        F.when(F.col("_u") == "D", days)
        .when(F.col("_u") == "B", F.filter(F.sequence(lo, hi, F.make_interval(days=F.lit(1))), lambda d: F.weekday(d) < 5))
        .when(F.col("_u") == "W", F.sequence(lo, hi, F.make_interval(days=F.col("_n") * 7)))
        .when(F.col("_u") == "M", months(1))
        .when(F.col("_u") == "Q", months(3))
        .when(F.col("_u") == "A", months(12))
        .when(F.col("_u").isin(*SECONDS), F.sequence(lo, hi, F.make_interval(days=F.lit(1))))
    )
    points = spans.select("*", F.explode(coarse).alias("_d"))
    step = F.create_map(*[F.lit(x) for u, s in SECONDS.items() for x in (u, s)])[F.col("_u")] * F.col("_n")
    step_us = F.coalesce(step, F.lit(86400)).cast("bigint") * 1_000_000
    # First grid point at or after the day mark, counted from the series start.
    since = F.unix_micros("_d") - F.unix_micros(lo)
    first = F.unix_micros(lo) + F.ceil(since / step_us) * step_us
    last = F.least(F.unix_micros("_d") + 86_400_000_000 - 1, F.unix_micros(hi))
    fine = F.when(last >= first, F.transform(F.sequence(first, last, step_us), lambda u: F.timestamp_micros(u)))
    inner = F.when(F.col("_u").isin(*SECONDS), fine).otherwise(F.array("_d"))
    grid = points.select(*keys, "_lo", "_hi", F.explode(inner).alias(ts))
    return grid.filter(col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def fill_grid(df: DataFrame, ts: str, by=(), freq: str | None = None, grid: DataFrame | None = None) -> DataFrame:
    """Left join of the grid with the data: missing points become empty rows."""
    by = list(by)
    df = as_timestamps(df, ts)
    grid = series_grid(df, ts, by, freq) if grid is None else grid
    on = _on([*by, ts], "g", "d")
    values = [c for c in df.columns if c != ts and c not in by]
    return grid.alias("g").join(df.alias("d"), on, "left").select(
        *[F.col(f"g.`{c}`") for c in [*by, ts]], *[F.col(f"d.`{c}`") for c in values]
    )


def regularise(df: DataFrame, ts: str, by=(), freq: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Fill missing dates on the detected grid, then impute the values."""
    by = list(by)
    columns = columns or [c for c in numeric_columns(df) if c not in by]
    clean = dedupe_timestamps(df, ts, by, columns)
    # The grid is only keys and times; written once, its size is known for free.
    grid = materialise(series_grid(clean, ts, by, freq), "grid")
    return impute_auto_ts(fill_grid(clean, ts, by, grid=grid), columns, ts, by, rows=grid.count())


def resample_daily_ffill(df: DataFrame, ts: str, by=(), columns: list[str] | None = None) -> DataFrame:
    """A row per day holding the last value at or before its midnight.

    Days and observations are merged and the last value is carried; nothing is
    joined on a range.
    """
    by = list(by)
    keys = [col(c) for c in by]
    df = as_timestamps(df, ts)
    columns = columns or [c for c in numeric_columns(df) if c not in by]
    spans = df.groupBy(*keys).agg(F.min(col(ts)).alias("lo"), F.max(col(ts)).alias("hi"))
    days = F.sequence(F.date_trunc("day", "lo"), F.date_trunc("day", "hi"), F.make_interval(days=F.lit(1)))
    grid = spans.select(*keys, F.explode(days).alias(ts))
    both = df.select(*keys, col(ts), *[col(c) for c in columns], F.lit(False).alias("_day")).unionByName(
        grid.select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns], F.lit(True).alias("_day"))
    )
    merged = both.groupBy(*keys, col(ts)).agg(
        *[F.max(col(c)).alias(c) for c in columns], F.max("_day").alias("_day")
    )
    carried = neighbours(merged, by, ts, columns)
    return carried.filter("_day").select(*keys, col(ts), *[F.col(f"_prev{i}.value").alias(c) for i, c in enumerate(columns)])


def series_patterns(df: DataFrame, ts: str, value: str, by=(), lags=(7, 30)) -> DataFrame:
    """Size, range, trend and seasonality of each series."""
    by = list(by)
    keys = [col(c) for c in by]
    base = df.select(*keys, col(ts), finite_double(df, value).alias("v"))
    lagged = over_preceding(base, by, ts, max(lags), lambda w: {f"l{k}": F.lag("v", k).over(w) for k in lags})
    aggs = [F.corr("v", f"l{k}").alias(f"r{k}") for k in lags]
    facts = lagged.groupBy(*keys).agg(
        F.count("*").alias("length"),
        F.count(F.when(F.col("v").isNull(), 1)).alias("missing"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.count("v").alias("known"),
        F.regr_slope("v", F.when(F.col("v").isNotNull(), F.col(POS).cast("double"))).alias("slope"),
        *aggs,
    )
    trend = (
        F.when(F.col("known") < 2, "unknown")
        .when(F.abs("slope") < 0.01, "no_trend")
        .when(F.col("slope") > 0, "increasing")
        .otherwise("decreasing")
    )
    strong = reduce(lambda a, b: a | b, [F.coalesce(F.abs(f"r{k}") > 0.3, F.lit(False)) for k in lags])
    season = F.when(F.col("known") <= 24, "unknown").when(strong, "likely_seasonal").otherwise("likely_non_seasonal")
    return facts.select(
        *keys,
        "length",
        "missing",
        (F.col("missing") * 100.0 / F.col("length")).alias("missing_percent"),
        "min",
        "max",
        "mean",
        "std",
        trend.alias("trend"),
        season.alias("seasonality"),
    )


def finite_double(df: DataFrame, name: str) -> Column:
    return finite(col(name).cast("double"))


def series_advice(df: DataFrame, ts: str, by=(), value_columns: int = 1) -> DataFrame:
    """One advice row per series of a panel."""
    keys = [col(c) for c in by]
    facts = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(col(ts)).alias("start"), F.max(col(ts)).alias("end"))
    extra = [MULTIVARIATE_MODEL] if value_columns > 1 else []
    models = F.when(F.col("rows") > 100, ",".join(LONG_MODELS + extra)).otherwise(",".join(SHORT_MODELS + extra))
    return facts.select(
        *keys,
        "rows",
        "start",
        "end",
        F.lit("univariate" if value_columns == 1 else "multivariate").alias("forecasting_type"),
        (F.col("rows") > 100).alias("deep_learning_suitable"),
        F.lit(12).alias("seasonal_periods"),
        F.least(F.lit(12), F.floor(F.col("rows") / 10)).cast("int").alias("horizon"),
        models.alias("suggested_models"),
    )


def process_series(
    df: DataFrame,
    ts: str,
    freq: str = "D",
    drop: list[str] = (),
    method: str = "auto",
    by=(),
    config: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Blanks, dates, columns, imputation, frequency, types, fill, report."""
    by = list(by)
    clean = normalise_floats(blank_to_null(null_tokens(df, SERIES_NULL_TOKENS)))
    dated = smart_parse(drop_empty_rows(clean), ts)
    if ts not in date_columns(dated):
        raise ValueError(f"{ts} can not be read as a date")
    spare = [c for c in drop if c in df.columns and c != ts and c not in by]
    kept = as_timestamps(drop_columns(dated, spare), ts)
    # Parsed once and written: every later step reads the typed rows.
    parsed = materialise(kept.filter(col(ts).isNotNull()), "parsed")
    numbers = [c for c in numeric_columns(parsed) if c not in by]
    texts = [c for c in parsed.columns if c not in numbers and c != ts and c not in by]
    unique = parsed.groupBy(*[col(c) for c in by], col(ts)).agg(
        *[F.avg(col(c)).alias(c) for c in numbers], *[F.min(col(c)).alias(c) for c in texts]
    )
    imputed, filled = impute_by_config(unique, ts, by, config, method, numbers)
    on = materialise(as_frequency(imputed, ts, freq, by), "regular")
    typed = numeric_if_mostly(on)
    done = inf_to_null_fill(typed)
    missing = filled.agg(F.sum("missing_before").alias("n")).first()["n"] or 0
    steps = [
        ("rows read", df.count()),
        ("rows with a date", parsed.count()),
        ("columns dropped", len(spare)),
        ("values missing before", missing),
        ("columns made numeric", len(numeric_columns(typed)) - len(numeric_columns(on))),
        ("rows written", on.count()),
    ]
    report = df.sparkSession.createDataFrame(
        [(i + 1, text, float(value)) for i, (text, value) in enumerate(steps)], "step int, text string, value double"
    )
    return done, report


def chrono_split(df: DataFrame, ts: str, by=(), train: float = 0.8, strict: bool = True) -> DataFrame:
    """Add `_pos` and `part` (train or test) by position in the series.

    With `strict`, every series needs 20 rows, 10 of them for training.
    """
    if not 0.1 <= train <= 0.9:
        raise ValueError("train share must lie in 0.1-0.9")
    by = list(by)
    keys = [col(c) for c in by]
    placed = with_position(df, by, ts)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    if strict:
        shortest = sizes.agg(F.min("_n").alias("n")).first()["n"] or 0
        if shortest < 20 or int(shortest * train) < 10 or shortest - int(shortest * train) < 1:
            raise ValueError("a series needs at least 20 rows, 10 for training and 1 for testing")
    if by:
        joined = placed.alias("l").join(sizes.alias("r"), _on(by, "l", "r")).select("l.*", "r._n")
    else:
        joined = placed.withColumn("_n", F.lit(sizes.first()["_n"]))
    cut = F.floor(F.col("_n") * F.lit(train))
    return joined.withColumn("part", F.when(F.col(POS) < cut, "train").otherwise("test")).drop("_n")
