"""Registered queries over the catalog-shaped raw table (catalog dataset kind)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as D
from ..operators import schema as A
from ..operators import stats as E
from . import prepare
from .registry import register
from .sql import with_catalog


@register("catalog_clean_rows", with_catalog("""
SELECT customer_id, product_id, category, price, revenue FROM cclean
"""))
def catalog_clean_rows(spark, sf_dir):
    """A2 + A5 (catalog) + B1/B5/B7 + C2/C3 + D1: catalog rows with revenue = price."""
    assert A.detect_dataset_type(A.canonicalise(prepare.catalog_raw(spark, sf_dir)).columns) == "catalog"
    return prepare.catalog_sales(spark, sf_dir).select("customer_id", "product_id", "category", "price",
                                                       "revenue")


@register("catalog_rfm", with_catalog("""
SELECT customer_id, CAST(count(DISTINCT product_id) AS BIGINT) AS frequency,
       round(sum(revenue), 2) AS monetary, 50.0::DOUBLE AS recency
FROM cclean GROUP BY customer_id
"""))
def catalog_rfm(spark, sf_dir):
    """D5 for data without ratings: distinct products, revenue, recency fixed at 50."""
    r = D.rfm_table(prepare.catalog_sales(spark, sf_dir), "catalog")
    return r.select("customer_id", "frequency", F.round("monetary", 2).alias("monetary"), "recency")


@register("catalog_stats", with_catalog("""
SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS total_customers,
       CAST(count(*) AS BIGINT) AS total_transactions,
       round(sum(revenue), 2) AS total_revenue, round(avg(revenue), 2) AS avg_order_value,
       'N/A' AS date_start, 'N/A' AS date_end, CAST(0 AS BIGINT) AS months_of_data,
       CAST((SELECT count(*) FROM cat_raw) - count(*) AS BIGINT) AS rows_removed, 'catalog' AS dataset_type,
       CAST(count(DISTINCT product_id) AS BIGINT) AS total_products, round(avg(price), 2) AS avg_price,
       printf('%.2f – %.2f', min(price), max(price)) AS price_range,
       0.0::DOUBLE AS mom_growth_pct, CAST(0 AS BIGINT) AS segments_found, 0.0::DOUBLE AS silhouette_score,
       'weak' AS silhouette_label, CAST(0 AS BIGINT) AS rules_found, 'empty' AS mining_mode
FROM cclean
"""))
def catalog_stats(spark, sf_dir):
    """E3 + E4 + E5 for catalog data (transactions = rows; mean price and price range)."""
    return E.full_stats(prepare.catalog_sales(spark, sf_dir), "catalog", raw=prepare.catalog_raw(spark, sf_dir))


@register("catalog_summary", with_catalog("""
SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS total_customers,
       CAST(count(DISTINCT product_id) AS BIGINT) AS total_products,
       CAST((SELECT count(*) FROM cat_raw) - count(*) AS BIGINT) AS rows_removed, 'catalog' AS dataset_type
FROM cclean
"""))
def catalog_summary(spark, sf_dir):
    """E1 for catalog data."""
    return E.dataset_summary(prepare.catalog_sales(spark, sf_dir), "catalog", raw=prepare.catalog_raw(spark, sf_dir))


@register("catalog_baskets", with_catalog("""
, p AS (SELECT DISTINCT customer_id, category FROM cclean WHERE category IS NOT NULL)
SELECT customer_id, customer_id AS basket_key, array_to_string(list_sort(list(category)), '|') AS items,
       CAST(count(*) AS BIGINT) AS n_lines
FROM p GROUP BY customer_id HAVING count(*) > 1
"""))
def catalog_baskets(spark, sf_dir):
    """D8 for catalog data: distinct categories per customer."""
    b = D.build_baskets(prepare.catalog_sales(spark, sf_dir), "catalog")
    return b.select("customer_id", "basket_key", F.array_join("items", "|").alias("items"), "n_lines")
