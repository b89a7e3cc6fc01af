"""Registered queries over the review-shaped raw table (sections A–E, review kind)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import features as D
from ..operators import schema as A
from ..operators import stats as E
from . import prepare
from .registry import register
from .sql import with_reviews


@register("review_unpack", with_reviews("""
SELECT trim(a_c[pos + 1]) AS customer_id, trim(a_t[pos + 1]) AS transaction_id, trim(a_n[pos + 1]) AS user_name,
       trim(a_r[pos + 1]) AS review_title, product_id
FROM rv_u
"""))
def review_unpack(spark, sf_dir):
    """A2 + A5 + C1: canonical names, kind 'review', one row per packed user."""
    df = A.canonicalise(prepare.review_raw(spark, sf_dir))
    assert A.detect_dataset_type(df.columns) == "review"
    u = C.unpack_packed_rows(df)
    return u.select("customer_id", "transaction_id", "user_name", "review_title", "product_id")


@register("review_typed", with_reviews("""
SELECT customer_id, product_id, category, price, actual_price, discount_pct, rating, quantity FROM rv_t
"""))
def review_typed(spark, sf_dir):
    """Currency, percent, thousands, rating text, category level, numeric coercion."""
    t = prepare.review_typed(spark, sf_dir)
    return t.select("customer_id", "product_id", "category", "price", "actual_price", "discount_pct", "rating",
                    "quantity")


@register("review_clean_rows", with_reviews("""
SELECT customer_id, product_id, transaction_id, user_name, category, price, actual_price, discount_pct, rating,
       quantity, round(revenue, 2) AS revenue, discount_amount
FROM rsales
"""))
def review_clean_rows(spark, sf_dir):
    """C2 + C5 + C6 + C7 + D1 + D3 on review data."""
    s = prepare.review_sales(spark, sf_dir)
    return s.select("customer_id", "product_id", "transaction_id", "user_name", "category", "price",
                    "actual_price", "discount_pct", "rating", "quantity", F.round("revenue", 2).alias("revenue"),
                    "discount_amount")


@register("review_rfm", with_reviews("""
, g AS (SELECT customer_id, count(DISTINCT product_id) AS frequency, sum(revenue) AS monetary,
               avg(rating) AS ar FROM rsales GROUP BY customer_id)
SELECT customer_id, CAST(coalesce(frequency, 0) AS BIGINT) AS frequency, round(coalesce(monetary, 0.0), 2) AS monetary,
       coalesce(round_even(CASE WHEN (5 - ar) * 20 < 0 THEN 0.0 ELSE (5 - ar) * 20 END, 0), 0.0) AS recency
FROM g
"""))
def review_rfm(spark, sf_dir):
    """Distinct products, revenue, recency from the mean rating."""
    r = D.rfm_review(prepare.review_sales(spark, sf_dir))
    return r.select("customer_id", "frequency", F.round("monetary", 2).alias("monetary"), "recency")


@register("review_baskets", with_reviews("""
, p AS (SELECT DISTINCT customer_id, category FROM rsales WHERE category IS NOT NULL)
SELECT customer_id, customer_id AS basket_key, array_to_string(list_sort(list(category)), '|') AS items,
       CAST(count(*) AS BIGINT) AS n_lines
FROM p GROUP BY customer_id HAVING count(*) > 1
"""))
def review_baskets(spark, sf_dir):
    """Distinct categories per customer, more than one."""
    b = D.build_baskets(prepare.review_sales(spark, sf_dir), "review")
    return b.select("customer_id", "basket_key", F.array_join("items", "|").alias("items"), "n_lines")


@register("review_summary", with_reviews("""
SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS total_customers,
       CAST(count(DISTINCT product_id) AS BIGINT) AS total_products,
       CAST((SELECT count(*) FROM rv_u) - count(*) AS BIGINT) AS rows_removed,
       'review' AS dataset_type, CAST(count(*) AS BIGINT) AS total_reviews,
       round(sum(revenue), 2) AS total_revenue, round(avg(revenue), 2) AS avg_order_value,
       round(avg(rating), 2) AS avg_rating,
       CAST(min(rating) AS VARCHAR) || ' – ' || CAST(max(rating) AS VARCHAR) AS rating_range,
       round(avg(discount_pct), 1) AS avg_discount_pct
FROM rsales
"""))
def review_summary(spark, sf_dir):
    """E1 for review data (rows removed counted after unpacking)."""
    unpacked = prepare.review_typed(spark, sf_dir)  # typing keeps every unpacked row
    return E.dataset_summary(prepare.review_sales(spark, sf_dir), "review", raw=unpacked)


@register("review_stats", with_reviews("""
SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS total_customers,
       CAST(count(DISTINCT transaction_id) AS BIGINT) AS total_transactions,
       round(sum(revenue), 2) AS total_revenue, round(avg(revenue), 2) AS avg_order_value,
       'N/A' AS date_start, 'N/A' AS date_end, CAST(0 AS BIGINT) AS months_of_data,
       CAST(0 AS BIGINT) AS rows_removed, 'review' AS dataset_type,
       round(avg(rating), 2) AS avg_rating, printf('%.1f – %.1f', min(rating), max(rating)) AS rating_range,
       round(avg(discount_pct), 1) AS avg_discount_pct, CAST(count(*) AS BIGINT) AS total_reviews,
       0.0::DOUBLE AS mom_growth_pct, CAST(0 AS BIGINT) AS segments_found, 0.0::DOUBLE AS silhouette_score,
       'weak' AS silhouette_label, CAST(0 AS BIGINT) AS rules_found, 'empty' AS mining_mode
FROM rsales
"""))
def review_stats(spark, sf_dir):
    """E3 + E4 + E5 for review data (no dates)."""
    return E.full_stats(prepare.review_sales(spark, sf_dir), "review")


@register("review_static_top_products", with_reviews("""
, g AS (SELECT product_id AS product_name, sum(revenue) AS v, round(avg(rating), 2) AS avg_rating
        FROM rsales GROUP BY 1)
SELECT row_number() OVER (ORDER BY v DESC, product_name) AS rank, product_name, round(v, 2) AS total_revenue,
       avg_rating
FROM g ORDER BY v DESC, product_name LIMIT 10
"""))
def review_static_top_products(spark, sf_dir):
    """Top products by revenue with mean rating (dateless data)."""
    return E.static_top_products(prepare.review_sales(spark, sf_dir), 10)


@register("review_admission", with_reviews("""
, n AS (SELECT (SELECT count(*) FROM rv_raw) AS input_rows, (SELECT count(*) FROM rv_u) AS unpacked_rows,
               (SELECT count(*) FROM rsales) AS clean_rows)
SELECT input_rows, clean_rows, unpacked_rows - clean_rows AS rows_removed,
       input_rows >= 100 AND clean_rows >= 10 AS admitted,
       CASE WHEN input_rows < 100 THEN printf('File has %d rows; at least 100 are needed.', input_rows)
            WHEN clean_rows < 10 THEN printf('After cleaning, only %d valid rows remained (%d rows removed). '
                                             || 'Please check your data quality.', clean_rows, unpacked_rows - clean_rows)
       END AS message
FROM n
"""))
def review_admission(spark, sf_dir):
    """Row-count gate on the upload's own rows and the cleaned rows."""
    unpacked = prepare.review_typed(spark, sf_dir)  # typing keeps every unpacked row
    return A.admission(prepare.review_raw(spark, sf_dir), prepare.review_sales(spark, sf_dir), unpacked=unpacked)
