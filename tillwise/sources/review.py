"""A review-shaped raw table derived from the test tables (FIXTURES §4 shape).

One raw row per order; the order's lines are packed into comma lists the way
review exports pack many users per product row:

* ``user_id``  – 'S<suppkey>' per line (null for every 97th order, 'nan' for every 89th)
* ``review_id`` – 'R<orderkey>-<linenumber>' per line
* ``user_name`` – supplier names of all lines but the last (shorter list)
* ``review_title`` – 'T<linenumber>' per line
* ``product_id`` – 'P<orderkey>'
* ``category`` – '<priority>|<status>' hierarchy
* ``discounted_price`` / ``actual_price`` – '₹12,345' text; actual is sometimes lower
* ``discount_percentage`` – '37%'
* ``rating`` – '3.7 out of 5 stars' (some outside 1..5)
* ``rating_count`` – '24,269'

Lists are ordered by the line's full key, so packing is deterministic. An
order has a bounded number of lines, so each packed list is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _thousands(x: Column) -> Column:
    """'₹<thousands>,<ddd>' text of a non-negative whole number."""
    x = x.cast("bigint")
    return F.concat(F.lit("₹"), (x / 1000).cast("bigint").cast("string"), F.lit(","),
                    F.lpad((x % 1000).cast("string"), 3, "0"))


def review_raw_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                      "l_extendedprice", "l_shipdate")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                   "o_orderpriority")
    lines = li.join(s, li.l_suppkey == s.s_suppkey, "left")
    line = F.struct(F.col("l_linenumber").alias("ln"), "l_partkey", F.col("l_suppkey").alias("sk"), "l_extendedprice", "l_shipdate",
                    F.col("s_name").alias("nm"))
    per = lines.groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("_mx"),
        F.array_sort(F.collect_list(line)).alias("_ls"))
    packed = per.select(
        "l_orderkey",
        F.array_join(F.transform("_ls", lambda x: F.concat(F.lit("S"), x["sk"].cast("string"))), ",").alias("_u"),
        F.array_join(F.transform("_ls", lambda x: F.concat(F.lit("R"), F.col("l_orderkey").cast("string"),
                                                           F.lit("-"), x["ln"].cast("string"))), ",").alias("_r"),
        F.array_join(F.transform(F.filter("_ls", lambda x: x["ln"] < F.col("_mx")), lambda x: x["nm"]), ",")
         .alias("_n"),
        F.array_join(F.transform("_ls", lambda x: F.concat(F.lit("T"), x["ln"].cast("string"))), ",").alias("_t"),
    )
    j = o.join(packed, o.o_orderkey == packed.l_orderkey)
    k = F.col("o_orderkey")
    user = F.when(k % 97 == 0, F.lit(None).cast("string")).when(k % 89 == 0, F.lit("nan")).otherwise(F.col("_u"))
    price = F.floor("o_totalprice")
    return j.select(
        user.alias("user_id"),
        F.col("_r").alias("review_id"),
        F.when(F.col("_n") == "", F.lit(None).cast("string")).otherwise(F.col("_n")).alias("user_name"),
        F.col("_t").alias("review_title"),
        F.concat(F.lit("P"), k.cast("string")).alias("product_id"),
        F.concat(F.col("o_orderpriority"), F.lit("|"), F.col("o_orderstatus")).alias("category"),
        _thousands(price).alias("discounted_price"),
        _thousands(price + 1000 * ((k % 5) - 1)).alias("actual_price"),
        F.concat((k % 70).cast("string"), F.lit("%")).alias("discount_percentage"),
        F.concat((k % 6).cast("string"), F.lit("."), (F.col("o_custkey") % 10).cast("string"),
                 F.lit(" out of 5 stars")).alias("rating"),
        _thousands(F.col("o_custkey") * 7).alias("rating_count_raw"),
        F.struct(k.alias("k")).alias("_ord"),
    ).withColumn("rating_count", F.regexp_replace("rating_count_raw", "₹", "")).drop("rating_count_raw")


def _thousands_sql(x: str) -> str:
    x = f"CAST({x} AS BIGINT)"
    return f"'₹' || CAST({x} // 1000 AS VARCHAR) || ',' || lpad(CAST({x} % 1000 AS VARCHAR), 3, '0')"


REVIEW_RAW_SQL = f"""
SELECT CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 89 = 0 THEN 'nan' ELSE p._u END AS user_id,
       p._r AS review_id, CASE WHEN p._n = '' THEN NULL ELSE p._n END AS user_name, p._t AS review_title,
       'P' || CAST(o.o_orderkey AS VARCHAR) AS product_id,
       o.o_orderpriority || '|' || o.o_orderstatus AS category,
       {_thousands_sql('floor(o.o_totalprice)')} AS discounted_price,
       {_thousands_sql('floor(o.o_totalprice) + 1000 * ((o.o_orderkey % 5) - 1)')} AS actual_price,
       CAST(o.o_orderkey % 70 AS VARCHAR) || '%' AS discount_percentage,
       CAST(o.o_orderkey % 6 AS VARCHAR) || '.' || CAST(o.o_custkey % 10 AS VARCHAR) || ' out of 5 stars' AS rating,
       replace({_thousands_sql('o.o_custkey * 7')}, '₹', '') AS rating_count,
       o.o_orderkey AS o_k
FROM orders o JOIN (
  SELECT l.l_orderkey,
         string_agg('S' || CAST(l.l_suppkey AS VARCHAR), ',' ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
                    l.l_extendedprice, l.l_shipdate) AS _u,
         string_agg('R' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR), ','
                    ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate) AS _r,
         coalesce(string_agg(s.s_name, ',' ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice,
                    l.l_shipdate) FILTER (WHERE l.l_linenumber < l.mx), '') AS _n,
         string_agg('T' || CAST(l.l_linenumber AS VARCHAR), ',' ORDER BY l.l_linenumber, l.l_partkey,
                    l.l_suppkey, l.l_extendedprice, l.l_shipdate) AS _t
  FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS mx FROM lineitem) l
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  GROUP BY l.l_orderkey) p ON o.o_orderkey = p.l_orderkey
"""
