"""Date detection, parsing and features.

Every rule is decided from ratios over whole columns, taken in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsmith.functions import date_rules as rules
from tabsmith.functions.columns import (
    col,
    date_columns,
    numeric_columns,
    select_with,
    string_columns,
)
from tabsmith.functions.stats import share
from tabsmith.operators.ordered import over_preceding


def by_format(c: Column, pattern: str, shape: str) -> Column:
    """Parse by one listed pattern; only texts of its shape are tried, because
    a failed parse costs an exception. Two-digit years from 69 are 19xx."""
    parsed = F.try_to_timestamp(c, F.lit(pattern))
    if "yyyy" not in pattern:
        earlier = parsed - F.make_interval(years=F.lit(100))
        parsed = F.when(F.year(parsed) >= 2069, earlier).otherwise(parsed)
    return F.when(c.rlike(f"^{shape}$"), parsed)


CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
ISO = rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:[ T]{CLOCK}| {CLOCK}\.\d{{1,6}})?$"
YEAR_FIRST = r"^(\d{4})([/.])(\d{1,2})\2(\d{1,2})$"
YEAR_LAST = rf"^(\d{{1,2}})([/-])(\d{{1,2}})\2(\d{{4}})((?<=/\d{{4}}) {CLOCK})?$"
DOTTED = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
SHORT = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
SHORT_YEAR_FIRST = r"^(\d{2})/(\d{1,2})/(\d{1,2})$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
ABBREVIATED = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
MONTH = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?"
    "|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
NAME_FIRST = rf"^(?i)({MONTH}) (\d{{1,2}}), (\d{{4}})$"
NAME_SECOND = rf"^(?i)(\d{{1,2}}) ({MONTH}) (\d{{4}})$"
NAME_DASHED = rf"^(?i)(\d{{1,2}})-({ABBREVIATED})-(\d{{4}})$"


def _named(c: Column, shape: str, name: int, day: int) -> Column:
    """Year, month number and day of a text with a month name."""
    key = F.lower(F.substring(F.regexp_extract(c, shape, name), 1, 3))
    month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), key) + 2) / 3
    return F.concat_ws("-", F.regexp_extract(c, shape, 3), month.cast("int").cast("string"), F.regexp_extract(c, shape, day))


def _short_year(c: Column, shape: str, year: int, rest: str) -> Column:
    century = F.when(F.regexp_extract(c, shape, year).cast("int") >= 69, "19").otherwise("20")
    return F.concat(century, F.regexp_replace(c, shape, rest))


def readings(c: Column, day_first: bool = False) -> Column:
    """Timestamp of a text in any listed format, in one reading order.

    Each shape is rewritten to an ISO text and cast, which costs no exception
    where it fails; ambiguous shapes are read a second time the other way round.
    """
    ahead = ("$4-$3-$1$5", "$3-$2-$1") if day_first else ("$4-$1-$3$5", "$3-$1-$2")
    other = ("$4-$1-$3$5", "$3-$1-$2") if day_first else ("$4-$3-$1$5", "$3-$2-$1")
    first = (
        F.when(c.rlike(ISO), c)
        .when(c.rlike(YEAR_LAST), F.regexp_replace(c, YEAR_LAST, ahead[0]))
        .when(c.rlike(YEAR_FIRST), F.regexp_replace(c, YEAR_FIRST, "$1-$3-$4"))
        .when(c.rlike(DOTTED), F.regexp_replace(c, DOTTED, "$3-$2-$1"))
        .when(c.rlike(COMPACT), F.regexp_replace(c, COMPACT, "$1-$2-$3"))
        .when(c.rlike(NAME_FIRST), _named(c, NAME_FIRST, 1, 2))
        .when(c.rlike(NAME_SECOND), _named(c, NAME_SECOND, 2, 1))
        .when(c.rlike(NAME_DASHED), _named(c, NAME_DASHED, 2, 1))
        .when(c.rlike(SHORT), _short_year(c, SHORT, 3, ahead[1]))
    )
    second = F.when(c.rlike(YEAR_LAST), F.regexp_replace(c, YEAR_LAST, other[0])).when(
        c.rlike(SHORT), _short_year(c, SHORT, 3, other[1])
    )
    third = F.when(c.rlike(SHORT_YEAR_FIRST), _short_year(c, SHORT_YEAR_FIRST, 1, "$1-$2-$3"))
    tried = F.coalesce(*[text.try_cast("timestamp") for text in (first, second, third)])
    # Every listed format has a four-digit year or two slashes: most other
    # texts leave after one test.
    return F.when((F.length(c) <= rules.LONGEST_DATE) & c.rlike(r"\d{4}|\d/\d{1,2}/\d"), tried)


def loose(c: Column) -> Column:
    """ISO texts with parts the list does not name, such as a time zone."""
    return F.when((F.length(c) <= rules.LONGEST_DATE) & c.rlike(r"^\d{4}\D"), c.try_cast("timestamp"))


def flexible_timestamp(c: Column, day_first: bool = False) -> Column:
    """A listed format, else a loose ISO text.

    A bare number such as a year or a count is not read as a date, except the
    eight-digit form the list names.
    """
    plain = F.trim(c)
    return F.coalesce(readings(plain, day_first), loose(plain))


def looks_like_date(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(patterns))


def _name_hits(name: str, hints: list[str]) -> bool:
    return any(h in name.lower() for h in hints)


def date_tests(df: DataFrame) -> list[Column]:
    """Aggregates C1 decides from; part of a wider aggregate where there is one."""
    aggs = []
    for i, c in enumerate(string_columns(df)):
        aggs.append(share(looks_like_date(col(c), rules.TABLE_DATE_PATTERNS), col(c)).alias(f"_match{i}"))
        aggs.append(share(flexible_timestamp(col(c)).isNotNull(), col(c)).alias(f"_parse{i}"))
    return aggs


def date_verdict(df: DataFrame, row) -> list[str]:
    """Typed dates; date-like names with one matching text; or columns of
    which more than half match a pattern and more than half parse."""
    found = set(date_columns(df))
    for i, c in enumerate(string_columns(df)):
        match, parse = row[f"_match{i}"] or 0.0, row[f"_parse{i}"] or 0.0
        if (_name_hits(c, rules.TABLE_DATE_NAMES) and match > 0) or (match > 0.5 and parse > 0.5):
            found.add(c)
    return [c for c in df.columns if c in found]


def detect_date_columns(df: DataFrame) -> list[str]:
    """C1 from one aggregate."""
    tests = date_tests(df)
    return date_verdict(df, df.agg(*tests).first() if tests else {})


def date_evidence(df: DataFrame) -> DataFrame:
    """C1 evidence: (column, match_ratio, parse_ratio, name_hint, is_date)."""
    texts = string_columns(df)
    rows = []
    for i, c in enumerate(texts):
        match = F.coalesce(share(looks_like_date(col(c), rules.TABLE_DATE_PATTERNS), col(c)), F.lit(0.0))
        parse = F.coalesce(share(flexible_timestamp(col(c)).isNotNull(), col(c)), F.lit(0.0))
        rows.append((c, f"m{i}", f"p{i}", match, parse))
    one = df.agg(*[e.alias(n) for _, m, p, a, b in rows for n, e in ((m, a), (p, b))])
    cells = []
    for c, m, p, _, _ in rows:
        hint = _name_hits(c, rules.TABLE_DATE_NAMES)
        is_date = ((F.col(m) > 0) if hint else F.lit(False)) | ((F.col(m) > 0.5) & (F.col(p) > 0.5))
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.round(m, 4).alias("match_ratio"),
                F.round(p, 4).alias("parse_ratio"),
                F.lit(hint).alias("name_hint"),
                is_date.alias("is_date"),
            )
        )
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def detect_date_columns_ts(df: DataFrame) -> DataFrame:
    """(column, reason) of the time columns of a series file."""
    texts, numbers = string_columns(df), numeric_columns(df)
    aggs = []
    for i, c in enumerate(texts):
        aggs.append(share(looks_like_date(col(c), rules.SERIES_DATE_PATTERNS), col(c)).alias(f"m{i}"))
        aggs.append(share(flexible_timestamp(col(c)).isNotNull(), col(c)).alias(f"p{i}"))
    for i, c in enumerate(numbers):
        aggs += [F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}")]
    row = df.agg(*aggs).first() if aggs else {}
    found = [(c, "typed") for c in date_columns(df)]
    for i, c in enumerate(texts):
        if (row[f"m{i}"] or 0) > 0.2 or (row[f"p{i}"] or 0) > 0.2:
            named = _name_hits(c, rules.SERIES_DATE_NAMES)
            found.append((c, "name and content" if named else "content"))
        elif c.lower() in rules.SERIES_EXACT_NAMES:
            found.append((c, "exact name"))
    for i, c in enumerate(numbers):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if c.lower() in rules.SERIES_EXACT_NAMES:
            found.append((c, "exact name"))
        elif lo is not None and rules.EPOCH_SECONDS[0] < lo and hi < rules.EPOCH_SECONDS[1]:
            found.append((c, "epoch seconds"))
        elif lo is not None and rules.EPOCH_MILLIS[0] < lo and hi < rules.EPOCH_MILLIS[1]:
            found.append((c, "epoch millis"))
    order = {c: i for i, c in enumerate(df.columns)}
    found.sort(key=lambda r: order[r[0]])
    return df.sparkSession.createDataFrame(found, "column string, reason string")


def score_time_columns(df: DataFrame, order: str | None = None) -> DataFrame:
    """+50 typed, +30 parseable, +20 keyword, +15 already in input order.

    `order` names the column that holds the input order; without it the order
    test is skipped, because a distributed frame has none of its own.
    """
    candidates = [c for c in df.columns if c != order]
    typed, texts, numbers = set(date_columns(df)), set(string_columns(df)), set(numeric_columns(df))
    aggs, parsed = [], {}
    for i, c in enumerate(candidates):
        aggs.append((F.count(col(c)) > 0).alias(f"any{i}"))
        if c in texts:
            parsed[c] = flexible_timestamp(col(c))
            words = ~F.lower(col(c)).isin("unknown", "na", "null", "none", "", "nan")
            bad = F.count(F.when(words & parsed[c].isNull(), 1))
            aggs.append(((bad == 0) & (F.count(parsed[c]) > 0)).alias(f"ok{i}"))
        elif c in numbers:
            (a, b), (u, v) = rules.SCORE_EPOCH_SECONDS, rules.SCORE_EPOCH_MILLIS
            seconds = (F.min(col(c)) >= a) & (F.max(col(c)) <= b)
            millis = (F.min(col(c)) >= u) & (F.max(col(c)) <= v)
            aggs.append(F.coalesce(seconds | millis, F.lit(False)).alias(f"ok{i}"))
            parsed[c] = col(c)
        elif c in typed:
            parsed[c] = col(c)
    row = df.agg(*aggs).first()
    ordered = {}
    checks = [c for i, c in enumerate(candidates) if order and (c in typed or (c in parsed and row[f"ok{i}"]))]
    if checks:
        keyed = df.select(col(order).alias("_o"), *[parsed[c].alias(f"v{i}") for i, c in enumerate(checks)])
        steps = over_preceding(
            keyed, [], "_o", 1,
            lambda w: {f"d{i}": F.col(f"v{i}") < F.lag(f"v{i}").over(w) for i in range(len(checks))},
        )
        falls = steps.agg(*[F.count(F.when(F.col(f"d{i}"), 1)).alias(f"d{i}") for i in range(len(checks))]).first()
        ordered = {c: falls[f"d{i}"] == 0 for i, c in enumerate(checks)}
    scored = []
    for i, c in enumerate(candidates):
        if not row[f"any{i}"] or c not in parsed:
            continue
        is_typed = c in typed
        parseable = not is_typed and bool(row[f"ok{i}"])
        keyword = _name_hits(c, rules.TIME_KEYWORDS)
        score = 50 * is_typed + 30 * parseable + 20 * keyword + 15 * bool(ordered.get(c))
        if score >= 30:
            scored.append((c, score, is_typed, parseable, keyword))
    scored.sort(key=lambda r: -r[1])
    return df.sparkSession.createDataFrame(
        [(i + 1, *r) for i, r in enumerate(scored)],
        "rank int, column string, score int, is_datetime boolean, parseable boolean, has_keyword boolean",
    )


def format_coverage(df: DataFrame, column: str) -> DataFrame:
    """C4 evidence: (position, format, hits, values) for each listed format."""
    c = col(column)
    aggs = [F.count(by_format(c, p, shape)).alias(f"n{i}") for i, (p, _, shape) in enumerate(rules.DATE_FORMATS)]
    one = df.agg(F.count(c).alias("values"), *aggs)
    cells = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(f).alias("format"), F.col(f"n{i}").alias("hits"))
        for i, (_, f, _) in enumerate(rules.DATE_FORMATS)
    ]
    return one.select("values", F.explode(F.array(*cells)).alias("r")).select("r.*", "values")


def detect_date_format(df: DataFrame, column: str) -> str | None:
    """C4: format covering the most values (at least half; first listed on a tie)."""
    best = format_coverage(df, column).agg(
        F.min_by(F.struct("format", "hits", "values"), F.struct(-F.col("hits"), F.col("position"))).alias("b")
    ).first()["b"]
    enough = best["values"] > 0 and best["hits"] >= 0.5 * best["values"]
    return best["format"] if enough else None


def parse_mixed_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per value, the first listed format, else a flexible parse, else null."""
    return select_with(df, {c: flexible_timestamp(col(c)) for c in columns})


def smart_parse(df: DataFrame, column: str) -> DataFrame:
    """Numbers by epoch range; texts day-first or month-first, whichever
    contradicts fewer values; accepted when more than half parse.

    A value whose leading field is above 12 can only be day first, one whose
    second field is above 12 only month first; month first wins a tie.
    """
    c = col(column)
    if column in numeric_columns(df):
        row = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        if row["lo"] is not None and rules.EPOCH_SECONDS[0] < row["lo"] and row["hi"] < rules.EPOCH_SECONDS[1]:
            return select_with(df, {column: F.timestamp_micros((c * 1000000).cast("bigint"))})
        if row["lo"] is not None and rules.EPOCH_MILLIS[0] < row["lo"] and row["hi"] < rules.EPOCH_MILLIS[1]:
            return select_with(df, {column: F.timestamp_micros((c * 1000).cast("bigint"))})
        return df
    if column not in string_columns(df):
        return df
    dayfirst, monthfirst = flexible_timestamp(c, day_first=True), flexible_timestamp(c)
    lead = F.regexp_extract(c, r"^\s*(\d{1,2})[/.\-]\d{1,2}[/.\-]\d{2,4}", 1).try_cast("int")
    second = F.regexp_extract(c, r"^\s*\d{1,2}[/.\-](\d{1,2})[/.\-]\d{2,4}", 1).try_cast("int")
    row = df.agg(
        F.count("*").alias("rows"),
        F.count(monthfirst).alias("parsed"),
        F.count(F.when(lead > 12, 1)).alias("only_day"),
        F.count(F.when(second > 12, 1)).alias("only_month"),
    ).first()
    if not row["parsed"] > 0.5 * row["rows"]:
        return df
    return select_with(df, {column: dayfirst if row["only_day"] > row["only_month"] else monthfirst})


def date_part(c: Column, part: str) -> Column:
    """Year, month, day, dayofweek (Monday 0) or quarter."""
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday, "quarter": F.quarter}
    return parts[part](c).cast("int")


def as_timestamp(df: DataFrame, column: str) -> Column:
    return flexible_timestamp(col(column)) if column in string_columns(df) else col(column).try_cast("timestamp")


def date_features(df: DataFrame, columns: list[str], parts: list[str] = rules.DATE_PARTS) -> DataFrame:
    """Add `<column>_<part>`; the column itself becomes its parsed form."""
    changed = {}
    for c in columns:
        parsed = as_timestamp(df, c)
        changed[c] = parsed
        changed.update({f"{c}_{p}": date_part(parsed, p) for p in rules.DATE_PARTS if p in parts})
    return select_with(df, changed)


def date_span(df: DataFrame, column: str) -> DataFrame:
    """First and last timestamp, rows, repeated timestamps.

    Repeats come from a grouped count, which merges a hot timestamp early.
    """
    per_value = df.groupBy(col(column).alias("v")).agg(F.count("*").alias("n"))
    return per_value.agg(
        F.min("v").alias("start"),
        F.max("v").alias("end"),
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("duplicates"),
    )
