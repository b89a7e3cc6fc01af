"""E: dataset summary, statistics row, top-k tables, monthly trends.

All of these are aggregates over the clean ``sales`` table. Window functions
without a partition (shares, lags over months) only run on already-aggregated
tables (months, categories), never on ``sales`` itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def _rows_removed(raw: DataFrame | None, clean: DataFrame) -> Column:
    if raw is None:
        return F.lit(0).cast("bigint")
    return (raw.select(F.count(F.lit(1))).scalar() - F.count(F.lit(1))).cast("bigint")


def _freq_col(df: DataFrame) -> str:
    return "transaction_id" if "transaction_id" in df.columns else "date"


def _n_distinct(df: DataFrame, *cols: str) -> Column:
    """Distinct values of ``cols`` as a scalar subquery: a narrow aggregate of its own.

    Several distinct counts in one aggregate would expand every row once per count.
    """
    known = df.select(*cols).na.drop()
    return known.distinct().agg(F.count(F.lit(1)).cast("bigint")).scalar()


# ── E1 ──────────────────────────────────────────────────────────────────────

def dataset_summary(sales: DataFrame, kind: str = "transactional", raw: DataFrame | None = None) -> DataFrame:
    """One row of headline numbers. avg_order_value is the mean per line (Q7)."""
    cols = set(sales.columns)
    aggs = [
        (_n_distinct(sales, "customer_id") if "customer_id" in cols else F.lit(0)).cast("bigint").alias("total_customers"),
        (_n_distinct(sales, "product_id") if "product_id" in cols else F.lit(0)).cast("bigint").alias("total_products"),
        _rows_removed(raw, sales).alias("rows_removed"),
        F.lit(kind).alias("dataset_type"),
    ]
    if kind == "transactional":
        aggs += [
            _n_distinct(sales, _freq_col(sales)).alias("total_transactions"),
            F.round(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("total_revenue"),
            F.round(F.avg("revenue"), 2).alias("avg_order_value"),
            N.day_str(F.min("date")).alias("date_start"),
            N.day_str(F.max("date")).alias("date_end"),
        ]
    elif kind == "review":
        aggs += [
            F.count(F.lit(1)).cast("bigint").alias("total_reviews"),
            F.round(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("total_revenue"),
            F.round(F.avg("revenue"), 2).alias("avg_order_value"),
        ]
        if "rating" in cols:
            aggs += [F.round(F.avg("rating"), 2).alias("avg_rating"),
                     F.format_string("%s – %s", F.min("rating"), F.max("rating")).alias("rating_range")]
        if "discount_pct" in cols:
            aggs.append(F.round(F.avg("discount_pct"), 1).alias("avg_discount_pct"))
    return sales.agg(*aggs)


# ── E2 / E11 ─────────────────────────────────────────────────────────────────

def top_categories(sales: DataFrame, n: int = 5) -> DataFrame:
    """Top categories by revenue (by row count when there is no revenue)."""
    if "revenue" in sales.columns:
        g = sales.groupBy("category").agg(F.sum("revenue").alias("_v"))
        val = F.round("_v", 2)
    else:
        g = sales.groupBy("category").agg(F.count(F.lit(1)).alias("_v"))
        val = F.col("_v").cast("double")
    top = g.orderBy(F.col("_v").desc(), F.col("category")).limit(n)
    w = Window.orderBy(F.col("_v").desc(), F.col("category"))
    return top.select(F.row_number().over(w).alias("rank"), "category", val.alias("value"))


def category_share(sales: DataFrame) -> DataFrame:
    """Revenue per category and its share of the total, 1 decimal."""
    g = sales.groupBy("category").agg(F.sum("revenue").alias("_rev"))
    tot = F.sum("_rev").over(Window.partitionBy())
    return g.select("category", F.round("_rev", 2).alias("revenue"),
                    F.round(F.col("_rev") / tot * 100, 1).alias("share_pct"))


# ── E3 / E4 / E5 ─────────────────────────────────────────────────────────────

def silhouette_label(score: Column) -> Column:
    """E5: strong / moderate / weak."""
    return F.when(score >= 0.5, "strong").when(score >= 0.3, "moderate").otherwise("weak")


def full_stats(sales: DataFrame, kind: str = "transactional", raw: DataFrame | None = None,
               segments_found: int | Column = 0, silhouette: float | Column = 0.0,
               rules_found: int | Column = 0, mining_mode: str | Column = "empty") -> DataFrame:
    """E3 + E4 + E5: one row with every field always present."""
    cols = set(sales.columns)
    if "transaction_id" in cols:
        tx = _n_distinct(sales, "transaction_id")
    elif kind == "transactional" and "date" in cols:
        tx = _n_distinct(sales, "customer_id", "date")
    else:
        tx = F.count(F.lit(1))
    if "revenue" in cols:
        money = F.col("revenue")
    elif "price" in cols:
        money = F.col("price")
    else:
        money = None
    aggs = [
        (_n_distinct(sales, "customer_id") if "customer_id" in cols else F.lit(0)).cast("bigint").alias("total_customers"),
        tx.cast("bigint").alias("total_transactions"),
        (F.round(F.coalesce(F.sum(money), F.lit(0.0)), 2) if money is not None else F.lit(0.0)).alias("total_revenue"),
        (F.round(F.coalesce(F.avg(money), F.lit(0.0)), 2) if money is not None else F.lit(0.0)).alias("avg_order_value"),
    ]
    if "date" in cols:
        mn, mx = F.min("date"), F.max("date")
        aggs += [F.coalesce(N.day_str(mn), F.lit("N/A")).alias("date_start"),
                 F.coalesce(N.day_str(mx), F.lit("N/A")).alias("date_end"),
                 F.coalesce((F.year(mx) - F.year(mn)) * 12 + F.month(mx) - F.month(mn) + 1, F.lit(0))
                  .cast("int").alias("months_of_data")]
    else:
        aggs += [F.lit("N/A").alias("date_start"), F.lit("N/A").alias("date_end"),
                 F.lit(0).alias("months_of_data")]
    aggs += [_rows_removed(raw, sales).alias("rows_removed"), F.lit(kind).alias("dataset_type")]
    aggs += _extras(sales, kind)
    base = sales.agg(*aggs)
    if "date" in cols and "revenue" in cols:
        mom = mom_growth(monthly_revenue(sales)).scalar()
    else:
        mom = F.lit(0.0)
    sil = silhouette if isinstance(silhouette, Column) else F.lit(float(silhouette))
    return base.select(
        "*",
        mom.alias("mom_growth_pct"),
        (segments_found if isinstance(segments_found, Column) else F.lit(segments_found)).alias("segments_found"),
        F.round(sil, 4).alias("silhouette_score"),
        silhouette_label(sil).alias("silhouette_label"),
        (rules_found if isinstance(rules_found, Column) else F.lit(rules_found)).alias("rules_found"),
        (mining_mode if isinstance(mining_mode, Column) else F.lit(mining_mode)).alias("mining_mode"),
    )


def _extras(sales: DataFrame, kind: str) -> list[Column]:
    """Per-kind extra fields."""
    cols = set(sales.columns)
    out = []
    if kind == "review":
        if "rating" in cols:
            out += [F.round(F.avg("rating"), 2).alias("avg_rating"),
                    F.format_string("%.1f – %.1f", F.min("rating"), F.max("rating")).alias("rating_range")]
        if "discount_pct" in cols:
            out.append(F.round(F.avg("discount_pct"), 1).alias("avg_discount_pct"))
        out.append(F.count(F.lit(1)).cast("bigint").alias("total_reviews"))
    elif kind == "transactional":
        if "product_id" in cols:
            out.append(_n_distinct(sales, "product_id").alias("total_products"))
        if "quantity" in cols:
            out.append(F.round(F.avg("quantity"), 2).alias("avg_quantity"))
    elif kind == "catalog":
        if "product_id" in cols:
            out.append(_n_distinct(sales, "product_id").alias("total_products"))
        if "price" in cols:
            out += [F.round(F.avg("price"), 2).alias("avg_price"),
                    F.format_string("%.2f – %.2f", F.min("price"), F.max("price")).alias("price_range")]
    return out


# ── E6–E9, E12 ───────────────────────────────────────────────────────────────

# ── Fixed values (must equal the reference's) ───────────────────────────────
DATE_CANDIDATES = ["date", "rating_date", "review_date", "order_date", "purchase_date"]
REVENUE_CANDIDATES = ["revenue", "discounted_price", "actual_price", "price"]
# ─────────────────────────────────────────────────────────────────────────────


def trend_columns(sales: DataFrame) -> tuple[str | None, str | None]:
    """The date column (5 candidates) and revenue column (4 candidates)."""
    d = next((c for c in DATE_CANDIDATES if c in sales.columns), None)
    r = next((c for c in REVENUE_CANDIDATES if c in sales.columns), None)
    return d, r


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per 'yyyy-MM', rounded to cents, ordered by month."""
    d, r = trend_columns(sales)
    return (sales.groupBy(N.month_str(F.col(d).cast("timestamp")).alias("month"))
                 .agg(F.round(F.sum(r), 2).alias("total_revenue"))
                 .filter(F.col("month").isNotNull())
                 .orderBy("month"))


def category_monthly(sales: DataFrame) -> DataFrame:
    """Revenue per (category, month)."""
    d, r = trend_columns(sales)
    return (sales.groupBy("category", N.month_str(F.col(d).cast("timestamp")).alias("month"))
                 .agg(F.round(F.sum(r), 2).alias("revenue"))
                 .filter(F.col("month").isNotNull())
                 .orderBy("category", "month"))


def category_monthly_nested(sales: DataFrame) -> DataFrame:
    """E7 as one row per category holding its ordered monthly series."""
    cm = category_monthly(sales)
    return cm.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct("month", "revenue"))).alias("monthly"))


def top_products(sales: DataFrame, n: int = 10, units: bool = False) -> DataFrame:
    """Products by revenue, top n (ties broken by name, Q4), on demand with the units sold."""
    _, r = trend_columns(sales)
    sums = [F.sum(r).alias("_v"), *([F.sum("quantity").cast("bigint").alias("total_quantity")] if units else [])]
    g = sales.groupBy("product_name").agg(*sums)
    top = g.orderBy(F.col("_v").desc(), F.col("product_name")).limit(n)
    w = Window.orderBy(F.col("_v").desc(), F.col("product_name"))
    return top.select(F.row_number().over(w).alias("rank"), "product_name",
                      F.round("_v", 2).alias("total_revenue"), *(["total_quantity"] if units else []))


def mom_growth(monthly: DataFrame) -> DataFrame:
    """Last month vs the one before, %, 1 decimal; 0 when not computable."""
    w = Window.orderBy("month")
    lagged = monthly.select("month", "total_revenue",
                            F.lag("total_revenue").over(w).alias("_prev"),
                            F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    last = lagged.orderBy(F.col("month").desc()).limit(1)
    g = F.when((F.col("_n") >= 2) & (F.col("_prev") > 0),
               F.round((F.col("total_revenue") - F.col("_prev")) / F.col("_prev") * 100, 1))\
        .otherwise(F.lit(0.0))
    one = monthly.sparkSession.range(1).select(
        F.coalesce(last.select(g).scalar(), F.lit(0.0)).alias("mom_growth_pct"))
    return one


def best_worst_month(monthly: DataFrame) -> DataFrame:
    """Best and worst month by revenue and the range between them."""
    return monthly.agg(
        F.max_by("month", F.struct("total_revenue", F.col("month"))).alias("best_month"),
        F.max("total_revenue").alias("best_revenue"),
        F.min_by("month", F.struct("total_revenue", F.col("month"))).alias("worst_month"),
        F.min("total_revenue").alias("worst_revenue"),
    ).withColumn("revenue_range", F.round(F.col("best_revenue") - F.col("worst_revenue"), 2))


# ── E10 ─────────────────────────────────────────────────────────────────────

def static_top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    """Top products by revenue with mean rating, for data without dates."""
    label = "product_name" if "product_name" in sales.columns else "product_id"
    aggs = [F.sum("revenue").alias("_v")]
    if "rating" in sales.columns:
        aggs.append(F.round(F.avg("rating"), 2).alias("avg_rating"))
    g = sales.groupBy(F.col(label).alias("product_name")).agg(*aggs)
    top = g.orderBy(F.col("_v").desc(), F.col("product_name")).limit(n)
    w = Window.orderBy(F.col("_v").desc(), F.col("product_name"))
    extra = ["avg_rating"] if "rating" in sales.columns else []
    return top.select(F.row_number().over(w).alias("rank"), "product_name",
                      F.round("_v", 2).alias("total_revenue"), *extra)


def static_category_revenue(sales: DataFrame, n: int = 8) -> DataFrame:
    """Top categories by revenue."""
    g = sales.groupBy("category").agg(F.sum("revenue").alias("_v"))
    top = g.orderBy(F.col("_v").desc(), F.col("category")).limit(n)
    w = Window.orderBy(F.col("_v").desc(), F.col("category"))
    return top.select(F.row_number().over(w).alias("rank"), "category", F.round("_v", 2).alias("revenue"))
