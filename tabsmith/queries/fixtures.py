"""Gaps and dirt put into the given tables, alike in Spark and SQL.

The tables have no missing values, so every seventh or so key gets one. The
rule depends on the key alone and keeps every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def gappy_orders(t) -> DataFrame:
    """orders with nulls in price, status and priority, and an empty column."""
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        "o_custkey",
        F.when(k % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 13 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 50 == 1, F.col("o_totalprice")).alias("o_rare"),
        F.lit(None).cast("string").alias("o_empty"),
    )


GAPPY_ORDERS = """
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 50 = 1 THEN o_totalprice END AS o_rare,
         CAST(NULL AS VARCHAR) AS o_empty
  FROM orders
"""


def dirty_customer(t) -> DataFrame:
    """customer as untidy texts: null tokens, blanks and money signs."""
    k = F.col("c_custkey")
    return t.customer.select(
        "c_custkey",
        F.when(k % 9 == 0, F.lit("N/A")).when(k % 10 == 0, F.lit("   ")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 8 == 0, F.lit("--"))
        .when(k % 5 == 0, F.lit("unknown amount"))
        .otherwise(F.concat(F.lit("$"), F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("%")))
        .alias("balance"),
        F.when(k % 6 == 0, F.lit("?"))
        .otherwise(F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
        .alias("points"),
        F.when(k % 12 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
    )


DIRTY_CUSTOMER = """
  SELECT c_custkey,
         CASE WHEN c_custkey % 9 = 0 THEN 'N/A' WHEN c_custkey % 10 = 0 THEN '   ' ELSE c_mktsegment END AS segment,
         CASE WHEN c_custkey % 8 = 0 THEN '--' WHEN c_custkey % 5 = 0 THEN 'unknown amount'
              ELSE '$' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) || '%' END AS balance,
         CASE WHEN c_custkey % 6 = 0 THEN '?' ELSE '1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END AS points,
         CASE WHEN c_custkey % 12 = 0 THEN '' ELSE c_name END AS name
  FROM customer
"""


def gappy_part(t) -> DataFrame:
    """part with nulls in size and price."""
    k = F.col("p_partkey")
    return t.part.select(
        "p_partkey",
        "p_brand",
        "p_type",
        F.when(k % 17 != 0, F.col("p_size")).alias("p_size"),
        F.when(k % 19 != 3, F.col("p_retailprice")).alias("p_retailprice"),
    )


GAPPY_PART = """
  SELECT p_partkey, p_brand, p_type,
         CASE WHEN p_partkey % 17 <> 0 THEN p_size END AS p_size,
         CASE WHEN p_partkey % 19 <> 3 THEN p_retailprice END AS p_retailprice
  FROM part
"""


def dated_orders(t) -> DataFrame:
    """orders with their date written in several ways."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.date_format(d, "yyyy-MM-dd").alias("iso_date"),
        F.when(k % 4 == 0, F.date_format(d, "dd.MM.yyyy"))
        .when(k % 4 == 1, F.date_format(d, "yyyy/MM/dd"))
        .when(k % 4 == 2, F.date_format(d, "dd-MMM-yyyy"))
        .otherwise(F.when(k % 40 == 3, F.lit("soon")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss")))
        .alias("mixed"),
        F.date_format(d, "dd/MM/yyyy").alias("euro"),
        F.when(k % 3 == 0, F.date_format(d, "yyyyMMdd")).otherwise(F.lit("note")).alias("remark"),
        F.unix_timestamp(d).alias("epoch"),
        (F.unix_timestamp(d) * 1000).alias("epoch_ms"),
        "o_orderpriority",
        F.col("o_orderdate").alias("typed"),
    )


DATED_ORDERS = """
  SELECT o_orderkey,
         strftime(o_orderdate, '%Y-%m-%d') AS iso_date,
         CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d.%m.%Y')
              WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y/%m/%d')
              WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%d-%b-%Y')
              WHEN o_orderkey % 40 = 3 THEN 'soon'
              ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS mixed,
         strftime(o_orderdate, '%d/%m/%Y') AS euro,
         CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'note' END AS remark,
         CAST(epoch(o_orderdate) AS BIGINT) AS epoch,
         CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS epoch_ms,
         o_orderpriority,
         o_orderdate AS typed
  FROM orders
"""


def daily(t) -> DataFrame:
    """Daily order value per priority: five series with missing days."""
    return t.orders.groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value")
    )


DAILY = """
  SELECT o_orderpriority AS series, o_orderdate AS ts, round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY 1, 2
"""


def gappy_daily(t) -> DataFrame:
    """`daily` with the value of every fifth day of the year missing."""
    gap = F.dayofyear("ts") % 5 == 0
    return daily(t).select("series", "ts", F.when(~gap, F.col("value")).alias("value"))


GAPPY_DAILY = f"""
  SELECT series, ts, CASE WHEN dayofyear(ts) % 5 <> 0 THEN value END AS value FROM ({DAILY})
"""


def monthly(t) -> DataFrame:
    """Monthly order value per priority, a complete short panel."""
    return t.orders.groupBy(
        F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").alias("ts")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


MONTHLY = """
  SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts,
         round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY 1, 2
"""
