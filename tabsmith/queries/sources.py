"""Queries for readers and writers (A). Files are written from the given tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tabsmith.operators import profile
from tabsmith.operators.clean import TABLE_NULL_TOKENS
from tabsmith.plans.params import load_params, save_params
from tabsmith.plans.auto_clean import auto_clean
from tabsmith.queries.fixtures import DIRTY_CUSTOMER, GAPPY_ORDERS, dirty_customer, gappy_orders
from tabsmith.queries.registry import query
from tabsmith.session import scratch_path
from tabsmith.sources import readers, writers

TOKENS = ", ".join(f"'{v}'" for v in TABLE_NULL_TOKENS)


@query(
    "a1_read_csv",
    f"""SELECT c_custkey, CASE WHEN segment NOT IN ({TOKENS}) THEN segment END AS segment, CASE WHEN balance NOT IN ({TOKENS}) THEN balance END AS balance,
      CASE WHEN points NOT IN ({TOKENS}) THEN points END AS points, CASE WHEN name NOT IN ({TOKENS}) THEN name END AS name FROM ({DIRTY_CUSTOMER})""",
)
def csv(t):
    path = scratch_path(t.spark, "csv")
    writers.write_csv(dirty_customer(t), path)
    return readers.read_csv(t.spark, path)


@query("a1_read_csv_types", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def typed(t):
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), path)
    return readers.read_csv(t.spark, path)


def delimited(t, path, sep, part):
    """Lines `key<sep>name<sep>balance` of customers, one folder per separator."""
    line = F.concat_ws(sep, F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"))
    t.customer.select(line.alias("value")).coalesce(1).write.text(f"{path}/{part}")


@query(
    "a2_detect_delimiter",
    r"""SELECT * FROM (VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9)), ('pipe', '|')) AS v(part, delimiter) WHERE (SELECT count(*) FROM customer) > 0""",
)
def delimiter(t):
    path = scratch_path(t.spark, "delimited")
    for part, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
        delimited(t, path, sep, part)
    found = readers.detect_delimiter(t.spark, f"{path}/*")
    return found.select(F.element_at(F.split("file", "/"), -2).alias("part"), "delimiter")


@query(
    "a3_read_csv_robust",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CASE WHEN c_custkey % 10 <> 3 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 10 <> 7""",
)
def robust(t):
    """Every tenth line has a field too many (skipped), another one too few (padded)."""
    k = F.col("c_custkey")
    line = (
        F.when(k % 10 == 7, F.concat_ws(";", k.cast("string"), "c_name", "c_mktsegment", F.lit("extra")))
        .when(k % 10 == 3, F.concat_ws(";", k.cast("string"), "c_name"))
        .otherwise(F.concat_ws(";", k.cast("string"), "c_name", "c_mktsegment"))
    )
    path = scratch_path(t.spark, "robust")
    lines = t.customer.select(line.alias("key; name;segment"))
    lines.write.options(header=True, sep="\u0001", quote="").csv(path)
    return readers.read_csv_robust(t.spark, path)[0]


REPAIRED = """SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 5 = 1 THEN '' ELSE c_name END AS name,
  CASE WHEN c_custkey % 5 = 1 OR c_custkey % 5 = 2 THEN '' ELSE c_mktsegment END AS segment FROM customer"""


@query("a4_repair_lines", REPAIRED)
def repaired(t):
    k = F.col("c_custkey")
    text = k.cast("string")
    line = (
        F.when(k % 5 == 1, text)
        .when(k % 5 == 2, F.concat_ws(",", text, "c_name"))
        .when(k % 5 == 3, F.concat_ws(",", text, "c_name", "c_mktsegment", F.lit("a"), F.lit("b")))
        .otherwise(F.concat_ws(",", text, "c_name", "c_mktsegment"))
    )
    path = scratch_path(t.spark, "ragged")
    t.customer.select(line.alias("key,name,segment")).write.options(header=True, sep="\u0001", quote="").csv(path)
    return readers.repair_lines(t.spark, path)


@query(
    "a5_normalise_encoding",
    """SELECT part, CASE part WHEN 'latin' THEN 'windows-1252' ELSE 'utf-8' END AS encoding, value, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT unnest(['latin', 'utf']) AS part, 'Prix ' || c_custkey || ' – café €' AS value FROM customer) GROUP BY 1, 2, 3""",
)
def encodings(t):
    path = scratch_path(t.spark, "encoded")
    text = F.concat(F.lit("Prix "), F.col("c_custkey").cast("string"), F.lit(" – café €"))
    t.customer.select(text.alias("value")).write.text(f"{path}/utf")
    # The same lines as windows-1252 bytes: the text writer stores bytes unchanged.
    swapped = F.translate(text, "–€", "\x96\x80")
    latin = F.encode(swapped, "ISO-8859-1").cast("string")
    t.customer.select(latin.alias("value")).write.text(f"{path}/latin")
    lines = readers.normalise_encoding(t.spark, f"{path}/*")
    part = F.element_at(F.split("file", "/"), -2).alias("part")
    return lines.groupBy(part, "encoding", "value").agg(F.count("*").alias("n"))


@query("a6_tidy_columns", 'SELECT s_suppkey AS "key", s_name AS "name_1", s_acctbal AS "name_2" FROM supplier')
def tidied(t):
    s = t.supplier
    untidy = s.select(
        F.col("s_suppkey").alias(" key "), F.col("s_name").alias("name"), F.col("s_acctbal").alias("name "),
        F.lit(None).cast("string").alias("gone"),
    )
    return readers.tidy_columns(untidy)


@query(
    "a7_read_archives",
    """SELECT 'region_' || n_regionkey || '.csv' AS member, count(*) + 1 AS lines, count(*) AS rows FROM nation GROUP BY 1""",
)
def archives(t):
    path = scratch_path(t.spark, "zip")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            rows = pdf.sort_values("n_nationkey")
            body = "key,name\n" + "".join(f"{k},{n}\n" for k, n in zip(rows["n_nationkey"], rows["n_name"]))
            z.writestr(f"region_{pdf['n_regionkey'].iloc[0]}.csv", body)
            z.writestr("__MACOSX/x.csv", "junk")
            z.writestr("readme.pdf", "junk")
        return pd.DataFrame({"part": [int(pdf["n_regionkey"].iloc[0])], "content": [held.getvalue()]})

    packed = t.nation.groupBy("n_regionkey").applyInPandas(pack, "part int, content binary")
    # Spark has no writer for binary files, so the archives stay in a table.
    packed.write.parquet(path)
    stored = t.spark.read.parquet(path).select(F.col("part").cast("string").alias("path"), "content")
    lines = readers.unpack_archives(stored)
    return lines.groupBy("member").agg(F.count("*").alias("lines"), F.count(F.when(F.col("line") > 0, 1)).alias("rows"))


@query(
    "a10_read_many_report",
    """SELECT o_orderpriority AS part, count(*) AS rows, 0::BIGINT AS bad_rows, count(*) FILTER (o_orderkey % 11 = 0) + count(*) FILTER (o_orderkey % 7 = 0) AS missing, 'ok' AS status FROM orders GROUP BY 1
    UNION ALL SELECT 'broken', 1, 1, 2, 'failed' """,
)
def many(t):
    path = scratch_path(t.spark, "many")
    k = F.col("o_orderkey")
    rows = t.orders.select(
        "o_orderkey",
        F.when(k % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.regexp_replace("o_orderpriority", " ", "_").alias("part"),
    )
    rows.repartition("part").write.partitionBy("part").options(header=True).csv(path)
    broken = t.orders.select(F.lit("no delimiter here").alias("o_orderkey")).limit(1)
    broken.coalesce(1).write.options(header=True).csv(f"{path}/part=broken")
    report = readers.read_many(t.spark, f"{path}/*")[1]
    part = F.regexp_replace(F.regexp_extract("file", "part=([^/]+)/", 1), "_", " ").alias("part")
    return report.groupBy(part).agg(
        F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"), F.sum("missing").alias("missing"), F.max("status").alias("status")
    )


@query("a11_write_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def written(t):
    path = scratch_path(t.spark, "part")
    writers.write_csv(t.part, path)
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    return t.spark.read.options(header=True, escape='"').schema(schema).csv(path)


@query(
    "a12_write_report",
    f"""WITH g AS ({GAPPY_ORDERS}) SELECT 'o_orderstatus' AS "column", count(*) - count(o_orderstatus) AS missing FROM g
    UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice) FROM g UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority) FROM g
    UNION ALL SELECT 'o_rare', count(*) - count(o_rare) FROM g UNION ALL SELECT 'o_empty', count(*) FROM g""",
)
def report(t):
    path = scratch_path(t.spark, "report")
    writers.write_report(profile.missing_stats(gappy_orders(t)).select("column", "missing"), path)
    return t.spark.read.schema("column string, missing bigint").json(path)


@query(
    "a13_saved_params",
    f"""WITH g AS ({GAPPY_ORDERS}) SELECT 'median' AS name, round(quantile_cont(o_totalprice, 0.5), 4)::VARCHAR AS value FROM g
    UNION ALL SELECT 'sparse', 'o_rare,o_empty' UNION ALL SELECT 'categories', '5'""",
)
def params(t):
    path = scratch_path(t.spark, "params")
    save_params(t.spark, auto_clean(gappy_orders(t), numeric="median").params, path)
    kept = load_params(t.spark, path)
    rows = [
        ("median", str(round(kept["fill"]["o_totalprice"], 4))),
        ("sparse", ",".join(kept["sparse"])),
        ("categories", str(len(kept["one_hot"]["o_orderpriority"]))),
    ]
    return t.spark.createDataFrame(rows, "name string, value string")


@query(
    "a14_sample_rows",
    """SELECT *, l_orderkey || '-' || l_linenumber AS id FROM lineitem
    ORDER BY CAST('0x' || substring(md5(l_orderkey || '-' || l_linenumber || chr(1) || '42'), 1, 8) AS BIGINT), id, l_partkey, l_suppkey LIMIT 10000""",
)
def sampled(t):
    return readers.sample_rows(t.lineitem.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "id", 10_000, 42)


@query("a15_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def previewed(t):
    return readers.preview(t.orders, "o_orderkey", 10)


@query(
    "a15_preview_pair",
    """SELECT c_custkey AS key, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS before,
      '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || lower(c_mktsegment) || '"}' AS after FROM customer ORDER BY c_custkey LIMIT 5""",
)
def pair(t):
    before = t.customer.select("c_custkey", "c_mktsegment")
    return readers.preview_pair(before, before.withColumn("c_mktsegment", F.lower("c_mktsegment")), "c_custkey", 5)
