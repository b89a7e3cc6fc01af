"""Driver test tables → the canonical ``sales`` fact table.

``sales`` = lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part, one row per line
item, projected to the canonical schema. Only ``nation`` is broadcast by hint:
it has one row per nation, a size bounded by definition. Every other join is a
plain equi-join and Spark picks the strategy from measured sizes (AQE converts
to broadcast only under ``autoBroadcastJoinThreshold``), so the plan stays a
shuffle join when part/customer grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_from_tables(spark: SparkSession, sf_dir: str, with_brand: bool = True) -> DataFrame:
    """Canonical transactional ``sales`` table built from the star schema.

    ``_ord`` is the input-order key: a struct of line-item columns that is
    unique per row (the (orderkey, linenumber) pair alone is not).
    """
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")

    # customers meet the orders, a fraction of the lines, so the lines move twice: by order and by part
    placed = o.join(c, o.o_custkey == c.c_custkey).drop("c_custkey")
    joined = (li.join(placed, li.l_orderkey == placed.o_orderkey)
                .join(p, li.l_partkey == p.p_partkey)
                .join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey))
    cols = [
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_orderkey").cast("string").alias("transaction_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
    ]
    if with_brand:
        cols.append(F.col("p_brand").alias("brand"))
    cols += [
        F.col("l_quantity").cast("double").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_discount") * 100).alias("discount_pct"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.col("n_name").alias("region"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                 "l_extendedprice").alias("_ord"),
    ]
    return joined.select(*cols)


def events_as_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a second transactional input: user → customer, value → price."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("event_type").alias("product_name"),
        F.col("event_type").alias("category"),
        F.lit(1.0).alias("quantity"),
        F.col("value").cast("double").alias("price"),
        F.col("ts").cast("timestamp").alias("date"),
        F.col("event_id").alias("_ord"),
    )


# Same table as ``sales_from_tables`` in DuckDB SQL, for the oracle queries.
SALES_SQL = """
SELECT CAST(o.o_custkey AS VARCHAR) AS customer_id,
       CAST(l.l_orderkey AS VARCHAR) AS transaction_id,
       CAST(l.l_partkey AS VARCHAR) AS product_id,
       p.p_name AS product_name,
       p.p_type AS category,
       p.p_brand AS brand,
       CAST(l.l_quantity AS DOUBLE) AS quantity,
       l.l_extendedprice / l.l_quantity AS price,
       l.l_discount * 100 AS discount_pct,
       CAST(o.o_orderdate AS TIMESTAMP) AS date,
       n.n_name AS region,
       l.l_orderkey AS o_k, l.l_linenumber AS o_ln, l.l_partkey AS o_pk,
       l.l_suppkey AS o_sk, l.l_shipdate AS o_sd, l.l_extendedprice AS o_ep
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

# Ordering of ``_ord`` spelled out for SQL (struct comparison is field by field).
ORD_SQL = "o_k, o_ln, o_pk, o_sk, o_sd, o_ep"

EVENTS_SALES_SQL = """
SELECT CAST(user_id AS VARCHAR) AS customer_id,
       CAST(event_id AS VARCHAR) AS transaction_id,
       event_type AS product_name,
       event_type AS category,
       1.0 AS quantity,
       CAST(value AS DOUBLE) AS price,
       CAST(ts AS TIMESTAMP) AS date,
       event_id AS o_k
FROM events
"""


def catalog_raw_from_tables(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """A catalog-shaped raw table (FIXTURES §5 shape) from lineitem ⋈ part.

    Raw column names ``buyer_id`` (the supplier), ``sku``, ``unit_price`` (text
    with a currency sign), ``product_category``; no date, quantity, rating or
    transaction id, so the dataset kind is catalog. Every 50th line has an
    unreadable price and every 61st a zero price, for the row filters. ``partitions``: the
    lines are dealt over so many by their key before any text is made of them.
    """
    li = read_table(spark, sf_dir, "lineitem")
    if partitions:
        li = (li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
                .repartition(partitions, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    price = (F.when(k % 50 == 0, F.lit("n/a"))
              .when(k % 61 == 0, F.lit("$0"))
              .otherwise(F.concat(F.lit("$"), F.col("l_extendedprice").cast("string"))))
    return j.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("buyer_id"),
        F.col("l_partkey").cast("string").alias("sku"),
        price.alias("unit_price"),
        F.col("p_type").alias("product_category"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                 "l_extendedprice").alias("_ord"),
    )


CATALOG_RAW_SQL = """
SELECT 'S' || CAST(l.l_suppkey AS VARCHAR) AS buyer_id, CAST(l.l_partkey AS VARCHAR) AS sku,
       CASE WHEN (l.l_orderkey * 10 + l.l_linenumber) % 50 = 0 THEN 'n/a'
            WHEN (l.l_orderkey * 10 + l.l_linenumber) % 61 = 0 THEN '$0'
            ELSE '$' || CAST(l.l_extendedprice AS VARCHAR) END AS unit_price,
       p.p_type AS product_category
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""
