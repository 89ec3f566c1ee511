"""Column helpers: quoting, type groups, null normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name; names may hold spaces, dots, # or brackets."""
    return F.col(quote(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def type_label(dtype: T.DataType) -> str:
    """Short type names used in reports."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, the only missing value in the library."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def select_with(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """One projection that replaces or appends columns, keeping order."""
    kept = [changed[c].alias(c) if c in changed else col(c) for c in df.columns]
    added = [e.alias(n) for n, e in changed.items() if n not in df.columns]
    return df.select(*kept, *added)


def normalise_floats(df: DataFrame) -> DataFrame:
    return select_with(df, {c: finite(col(c)) for c in fractional_columns(df)})


def order_value(c: Column, dtype: T.DataType) -> Column:
    """Order-preserving double for a numeric, date or timestamp column."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def md5_number(*parts: Column) -> Column:
    """A number below 2**32 from the MD5 of the texts joined by a control character; other engines have it too."""
    joined = F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("bigint")
