"""Registered queries for section E (summary, statistics, trends)."""

from __future__ import annotations

from ..operators import stats as E
from . import prepare
from .registry import register
from .sql import with_sales


@register("dataset_summary", with_sales("""
SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS total_customers,
       CAST(count(DISTINCT product_id) AS BIGINT) AS total_products,
       CAST((SELECT count(*) FROM sales_raw) - count(*) AS BIGINT) AS rows_removed,
       'transactional' AS dataset_type,
       CAST(count(DISTINCT transaction_id) AS BIGINT) AS total_transactions,
       round(sum(revenue), 2) AS total_revenue,
       round(avg(revenue), 2) AS avg_order_value,
       strftime(min(date), '%Y-%m-%d') AS date_start,
       strftime(max(date), '%Y-%m-%d') AS date_end
FROM sales
"""))
def dataset_summary(spark, sf_dir):
    """E1."""
    return E.dataset_summary(prepare.clean_sales(spark, sf_dir), "transactional",
                             raw=prepare.raw_sales(spark, sf_dir))


@register("top_categories", with_sales("""
, g AS (SELECT category, sum(revenue) AS v FROM sales GROUP BY category)
SELECT row_number() OVER (ORDER BY v DESC, category) AS rank, category, round(v, 2) AS value
FROM g ORDER BY v DESC, category LIMIT 5
"""))
def top_categories(spark, sf_dir):
    """E2."""
    return E.top_categories(prepare.clean_sales(spark, sf_dir), 5)


@register("category_share", with_sales("""
, g AS (SELECT category, sum(revenue) AS v FROM sales GROUP BY category)
SELECT category, round(v, 2) AS revenue, round(v / sum(v) OVER () * 100, 1) AS share_pct FROM g
"""))
def category_share(spark, sf_dir):
    """E11."""
    return E.category_share(prepare.clean_sales(spark, sf_dir))


MONTHLY = """
, m AS (SELECT strftime(date, '%Y-%m') AS month, round(sum(revenue), 2) AS total_revenue
        FROM sales GROUP BY 1),
ml AS (SELECT month, total_revenue, lag(total_revenue) OVER (ORDER BY month) AS prev,
              count(*) OVER () AS n FROM m),
mom AS (SELECT CASE WHEN n >= 2 AND prev > 0 THEN round((total_revenue - prev) / prev * 100, 1) + 0.0
                    ELSE 0.0 END AS mom_growth_pct
        FROM ml ORDER BY month DESC LIMIT 1)
"""


@register("monthly_revenue", with_sales(MONTHLY + "SELECT month, total_revenue FROM m"))
def monthly_revenue(spark, sf_dir):
    """E6."""
    return E.monthly_revenue(prepare.clean_sales(spark, sf_dir))


@register("category_monthly", with_sales("""
SELECT category, strftime(date, '%Y-%m') AS month, round(sum(revenue), 2) AS revenue
FROM sales GROUP BY 1, 2
"""))
def category_monthly(spark, sf_dir):
    """E7."""
    return E.category_monthly(prepare.clean_sales(spark, sf_dir))


@register("top_products", with_sales("""
, g AS (SELECT product_name, sum(revenue) AS v FROM sales GROUP BY product_name)
SELECT row_number() OVER (ORDER BY v DESC, product_name) AS rank, product_name,
       round(v, 2) AS total_revenue
FROM g ORDER BY v DESC, product_name LIMIT 10
"""))
def top_products(spark, sf_dir):
    """E8."""
    return E.top_products(prepare.clean_sales(spark, sf_dir), 10)


@register("mom_growth", with_sales(MONTHLY + "SELECT mom_growth_pct FROM mom"))
def mom_growth(spark, sf_dir):
    """E9."""
    return E.mom_growth(E.monthly_revenue(prepare.clean_sales(spark, sf_dir)))


@register("best_worst_month", with_sales(MONTHLY + """
SELECT arg_max(month, total_revenue) AS best_month, max(total_revenue) AS best_revenue,
       arg_min(month, total_revenue) AS worst_month, min(total_revenue) AS worst_revenue,
       round(max(total_revenue) - min(total_revenue), 2) AS revenue_range
FROM m
"""))
def best_worst_month(spark, sf_dir):
    """E12."""
    return E.best_worst_month(E.monthly_revenue(prepare.clean_sales(spark, sf_dir)))


@register("full_stats", with_sales(MONTHLY + """
SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS total_customers,
       CAST(count(DISTINCT transaction_id) AS BIGINT) AS total_transactions,
       round(sum(revenue), 2) AS total_revenue, round(avg(revenue), 2) AS avg_order_value,
       strftime(min(date), '%Y-%m-%d') AS date_start, strftime(max(date), '%Y-%m-%d') AS date_end,
       CAST((year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)) + 1 AS BIGINT)
         AS months_of_data,
       CAST((SELECT count(*) FROM sales_raw) - count(*) AS BIGINT) AS rows_removed,
       'transactional' AS dataset_type,
       CAST(count(DISTINCT product_id) AS BIGINT) AS total_products,
       round(avg(quantity), 2) AS avg_quantity,
       (SELECT mom_growth_pct FROM mom) AS mom_growth_pct,
       CAST(0 AS BIGINT) AS segments_found, CAST(0.0 AS DOUBLE) AS silhouette_score, 'weak' AS silhouette_label,
       CAST(0 AS BIGINT) AS rules_found, 'empty' AS mining_mode
FROM sales
"""))
def full_stats(spark, sf_dir):
    """E3 + E4 + E5 (segmentation / rules fields at their defaults)."""
    return E.full_stats(prepare.clean_sales(spark, sf_dir), "transactional", raw=prepare.raw_sales(spark, sf_dir))


@register("static_top_products", with_sales("""
, g AS (SELECT product_name, sum(revenue) AS v FROM sales GROUP BY product_name)
SELECT row_number() OVER (ORDER BY v DESC, product_name) AS rank, product_name,
       round(v, 2) AS total_revenue
FROM g ORDER BY v DESC, product_name LIMIT 10
"""))
def static_top_products(spark, sf_dir):
    """E10 products (the clean sales carry no rating, so no mean rating column)."""
    return E.static_top_products(prepare.clean_sales(spark, sf_dir).drop("date"), 10)


@register("static_category_revenue", with_sales("""
, g AS (SELECT category, sum(revenue) AS v FROM sales GROUP BY category)
SELECT row_number() OVER (ORDER BY v DESC, category) AS rank, category, round(v, 2) AS revenue
FROM g ORDER BY v DESC, category LIMIT 8
"""))
def static_category_revenue(spark, sf_dir):
    """E10 categories."""
    return E.static_category_revenue(prepare.clean_sales(spark, sf_dir), 8)
