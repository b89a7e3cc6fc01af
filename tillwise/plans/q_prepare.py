"""Registered queries for sections C and D on the transactional test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import features as D
from . import prepare
from .registry import register
from .sql import with_events, with_sales


@register("clean_counts", with_sales("""
, raw_n AS (SELECT count(*) AS rows_in FROM sales_raw)
SELECT raw_n.rows_in AS rows_in, (SELECT count(*) FROM sales) AS rows_kept,
       raw_n.rows_in - (SELECT count(*) FROM sales) AS rows_removed
FROM raw_n
"""))
def clean_counts(spark, sf_dir):
    """Rows in / kept / removed by the transactional cleaning."""
    return C.removed_counts(prepare.raw_sales(spark, sf_dir), prepare.clean_sales(spark, sf_dir))


@register("clean_reject_counts", with_sales("""
SELECT count(*) AS rows_in,
       count(*) FILTER (WHERE customer_id IS NULL) AS missing_customer,
       count(*) FILTER (WHERE date IS NULL) AS missing_date,
       count(*) FILTER (WHERE price IS NULL) AS missing_price,
       count(*) FILTER (WHERE quantity IS NULL) AS missing_quantity,
       count(*) FILTER (WHERE quantity <= 0) AS non_positive_quantity,
       count(*) FILTER (WHERE price <= 0) AS non_positive_price
FROM sales_raw
"""))
def clean_reject_counts(spark, sf_dir):
    """C8 per rule."""
    return C.reject_counts(prepare.raw_sales(spark, sf_dir), "transactional")


@register("iqr_clean_sales", with_sales("""
SELECT customer_id, transaction_id, product_id, price, quantity,
       round(revenue, 2) AS revenue, day_of_week, month, strftime(date, '%Y-%m-%d') AS day
FROM sales
"""))
def iqr_clean_sales(spark, sf_dir):
    """C2–C4 + D1–D2: the clean transactional lines with their features."""
    s = prepare.clean_sales(spark, sf_dir)
    return s.select("customer_id", "transaction_id", "product_id", "price",
                    "quantity", F.round("revenue", 2).alias("revenue"), "day_of_week", "month",
                    F.date_format("date", "yyyy-MM-dd").alias("day"))


_RFM_SQL = """
, snap AS (SELECT max(date) + INTERVAL 1 DAY AS snapshot FROM {t})
SELECT customer_id, CAST(count(DISTINCT transaction_id) AS BIGINT) AS frequency,
       round(sum(revenue), 2) AS monetary,
       CAST(floor((epoch_us((SELECT snapshot FROM snap)) - epoch_us(max(date))) / 86400000000) AS BIGINT) AS recency
FROM {t} GROUP BY customer_id
"""


@register("rfm_transactional", with_sales(_RFM_SQL.format(t="sales")))
def rfm_transactional(spark, sf_dir):
    """One row per customer with frequency, monetary, recency."""
    r = D.rfm_transactional(prepare.clean_sales(spark, sf_dir))
    return r.select("customer_id", "frequency", F.round("monetary", 2).alias("monetary"), "recency")


@register("rfm_events", with_events(_RFM_SQL.format(t="ev")))
def rfm_events(spark, sf_dir):
    """D4 on the second input (events as sales)."""
    r = D.rfm_transactional(prepare.events_sales(spark, sf_dir))
    return r.select("customer_id", "frequency", F.round("monetary", 2).alias("monetary"), "recency")


@register("rfm_scaled", with_sales("""
, snap AS (SELECT max(date) + INTERVAL 1 DAY AS snapshot FROM sales),
r AS (
  SELECT customer_id, count(DISTINCT transaction_id) AS frequency, sum(revenue) AS monetary,
         floor((epoch_us((SELECT snapshot FROM snap)) - epoch_us(max(date))) / 86400000000) AS recency
  FROM sales GROUP BY customer_id),
f AS (SELECT customer_id, CAST(recency AS DOUBLE) AS xr, ln(1 + greatest(frequency, 0)) AS xf,
             ln(1 + greatest(monetary, 0)) AS xm FROM r),
q AS (SELECT quantile_cont(xr, 0.5) AS mr, quantile_cont(xr, 0.75) - quantile_cont(xr, 0.25) AS ir,
             quantile_cont(xf, 0.5) AS mf, quantile_cont(xf, 0.75) - quantile_cont(xf, 0.25) AS i_f,
             quantile_cont(xm, 0.5) AS mm, quantile_cont(xm, 0.75) - quantile_cont(xm, 0.25) AS im FROM f)
SELECT customer_id,
       round((xr - mr) / CASE WHEN ir = 0 THEN 1 ELSE ir END, 4) + 0.0 AS recency_scaled,
       round((xf - mf) / CASE WHEN i_f = 0 THEN 1 ELSE i_f END, 4) + 0.0 AS frequency_scaled,
       round((xm - mm) / CASE WHEN im = 0 THEN 1 ELSE im END, 4) + 0.0 AS monetary_scaled
FROM f, q
"""))
def rfm_scaled(spark, sf_dir):
    """log1p + robust scaling with exact quartiles."""
    r = prepare.customer_rfm(spark, sf_dir)
    return r.select("customer_id", *[F.round(c, 4).alias(c) for c in
                                     ("recency_scaled", "frequency_scaled", "monetary_scaled")])


@register("baskets_transactional", with_sales("""
, pairs AS (SELECT customer_id, transaction_id AS basket_key, product_name AS item, count(*) AS n
            FROM sales WHERE product_name IS NOT NULL GROUP BY 1, 2, 3)
SELECT customer_id, basket_key, array_to_string(list_sort(list(item)), '|') AS items,
       CAST(sum(n) AS BIGINT) AS n_lines
FROM pairs GROUP BY customer_id, basket_key HAVING sum(n) > 1
"""))
def baskets_transactional(spark, sf_dir):
    """Product-name baskets per (customer, transaction) with more than one line."""
    b = D.build_baskets(prepare.clean_sales(spark, sf_dir), "transactional")
    return b.select("customer_id", "basket_key", F.array_join("items", "|").alias("items"), "n_lines")


@register("date_two_digit_years", """
WITH o AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders)
SELECT year(d) AS year, count(*) AS orders, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day,
       (SELECT count(*) FROM o WHERE d IS NULL) AS rejected FROM o WHERE d IS NOT NULL GROUP BY 1
""")
def date_two_digit_years(spark, sf_dir):
    """B8 + C8: order dates written as dd-MM-yy, one in fifty unreadable, read back with their century and the rejects."""
    from ..sources.tables import read_table
    text = F.when(F.col("o_orderkey") % 50 == 0, F.lit("unknown")).otherwise(F.date_format("o_orderdate", "dd-MM-yy"))
    raw = read_table(spark, sf_dir, "orders").select(text.alias("date"))
    typed = C.coerce_types(raw)
    day = F.col("date").cast("date").cast("string")
    years = typed.where("date IS NOT NULL").groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("orders"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return years.withColumn("rejected", C.date_rejects(raw, typed).select("date_rejected").scalar())
