"""Queries for streams (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.plans.auto_clean import auto_clean
from tabsmith.queries.features import four
from tabsmith.queries.registry import query
from tabsmith.session import scratch_path
from tabsmith.streaming.flows import apply_params_stream, ingest_stream

PLAIN = """SELECT c_custkey, coalesce(c_acctbal, 0) AS c_acctbal, c_nationkey, c_mktsegment, c_name,
  """ + ", ".join(f"c_mktsegment = '{v}' AS \"c_mktsegment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer"


@query("s1_serve_stream", PLAIN)
def served(t):
    """Parameters learnt on the table, applied to the table read as a stream."""
    params = auto_clean(t.customer, numeric="median").params
    root = scratch_path(t.spark, "served")
    stream = t.spark.readStream.schema(t.customer.schema).parquet(f"{t.folder}/customer*.parquet")
    apply_params_stream(stream, params, f"{root}/out", f"{root}/checkpoint")
    return four(t.spark.read.parquet(f"{root}/out"))


FILES = 4


def arrive(t, root):
    """Customers as CSV files in a folder, and one file of broken lines."""
    t.customer.repartition(FILES).write.options(header=True).csv(f"{root}/in/good")
    broken = t.customer.select(F.lit("not a customer").alias("c_custkey")).limit(3)
    broken.coalesce(1).write.options(header=True).csv(f"{root}/in/bad")
    params = auto_clean(t.customer, numeric="median").params
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ingest_stream(t.spark, f"{root}/in/*", schema, params, f"{root}/out", f"{root}/reports", f"{root}/checkpoint")


@query("s2_ingest_stream", PLAIN)
def ingested(t):
    root = scratch_path(t.spark, "ingest")
    arrive(t, root)
    return four(t.spark.read.parquet(f"{root}/out").drop("batch"))


@query(
    "s2_ingest_reports",
    "SELECT 'ok' AS status, 4::BIGINT AS files, count(*) AS rows, 0::BIGINT AS bad_rows FROM customer UNION ALL SELECT 'failed', 1, 3, 3",
)
def reports(t):
    root = scratch_path(t.spark, "ingest")
    arrive(t, root)
    rows = t.spark.read.schema("file string, rows bigint, bad_rows bigint, missing bigint, status string").json(f"{root}/reports/*")
    return rows.groupBy("status").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"))
