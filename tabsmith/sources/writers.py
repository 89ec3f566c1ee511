"""Sinks (A11, A12); parameters are saved in plans/params.py."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, one file per task."""
    df.write.mode(mode).options(header=True, escape='"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report rows as JSON lines next to the data."""
    report.write.mode(mode).json(path)
