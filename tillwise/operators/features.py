"""D: revenue and calendar features, RFM tables, robust scaling, baskets.

RFM is one ``groupBy(customer_id)`` with partial aggregation on the map side
(count distinct runs as a two-level aggregate keyed by (customer, transaction)),
so a customer holding a third of all rows still arrives at the final stage as
one partial row per map partition. The snapshot date is a scalar subquery, not
a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.quantile import exact_quantiles_multi
from ..session import scratch_table


# ── D1–D3 ───────────────────────────────────────────────────────────────────

def engineer_features(df: DataFrame, kind: str) -> DataFrame:
    """D1 revenue per kind, D2 weekday (Mon=0) and month, D3 discount amount."""
    cols = set(df.columns)
    if kind == "transactional":
        return df.withColumns({
            "revenue": F.col("quantity") * F.col("price"),
            "day_of_week": F.weekday("date"),
            "month": F.month("date"),
        })
    if kind == "review":
        if "price" in cols and "quantity" in cols:
            rev = F.col("price") * F.coalesce(F.col("quantity"), F.lit(1.0))
        elif "price" in cols:
            rev = F.col("price")
        else:
            rev = F.lit(1.0)
        out = df.withColumn("revenue", rev.cast("double"))
        if "actual_price" in cols and "price" in cols:
            diff = F.col("actual_price") - F.col("price")
            out = out.withColumn("discount_amount", F.when(diff < 0, F.lit(0.0)).otherwise(diff))
        return out
    return df.withColumn("revenue", F.col("price"))


# ── D4–D6 ───────────────────────────────────────────────────────────────────

def rfm_transactional(sales: DataFrame) -> DataFrame:
    """Frequency (distinct transactions, else dates), monetary, recency days.

    Recency counts whole days from the last purchase to max(date) + 1 day.
    """
    freq_col = "transaction_id" if "transaction_id" in sales.columns else "date"
    snapshot = sales.select(F.max("date") + F.expr("INTERVAL 1 DAY")).scalar()
    agg = sales.groupBy("customer_id").agg(
        F.count_distinct(freq_col).alias("frequency"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("monetary"),
        F.max("date").alias("_last"),
    )
    return agg.select("customer_id", F.col("frequency").cast("bigint").alias("frequency"),
                      "monetary", N.elapsed_days(snapshot, F.col("_last")).alias("recency"))


def rfm_review(sales: DataFrame) -> DataFrame:
    """Distinct products, total revenue, recency from the mean rating."""
    has_rating = "rating" in sales.columns
    aggs = [F.count_distinct("product_id").alias("frequency"),
            F.sum("revenue").alias("monetary")]
    if has_rating:
        aggs.append(F.avg("rating").alias("_avg_rating"))
    agg = sales.groupBy("customer_id").agg(*aggs)
    if has_rating:
        raw = (F.lit(5.0) - F.col("_avg_rating")) * 20
        rec = F.bround(F.when(raw < 0, F.lit(0.0)).otherwise(raw), 0)
    else:
        rec = F.lit(50.0)
    return agg.select("customer_id",
                      F.coalesce(F.col("frequency").cast("bigint"), F.lit(0)).alias("frequency"),
                      F.coalesce(F.col("monetary"), F.lit(0.0)).alias("monetary"),
                      F.coalesce(rec.cast("double"), F.lit(0.0)).alias("recency"))


def rfm_table(sales: DataFrame, kind: str) -> DataFrame:
    return rfm_transactional(sales) if kind == "transactional" else rfm_review(sales)


def _nonneg(c):
    return F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c).cast("double"))


def scale_features(rfm: DataFrame) -> DataFrame:
    """The three model inputs before scaling: raw recency, log1p frequency and monetary."""
    return rfm.withColumns({
        "_r": F.col("recency").cast("double"),
        "_f": F.log1p(_nonneg("frequency")),
        "_m": F.log1p(_nonneg("monetary")),
    })


def robust_scale(rfm: DataFrame) -> DataFrame:
    """(x − median) / (p75 − p25), a zero spread divides by 1.

    The nine exact quantiles come from one shared refinement (driver holds only
    bucket counts); the scaling itself is a projection with literals.
    """
    feats = scale_features(rfm)
    q = exact_quantiles_multi(feats, ["_r", "_f", "_m"], [0.25, 0.5, 0.75])
    out = feats
    for src, dst in (("_r", "recency_scaled"), ("_f", "frequency_scaled"), ("_m", "monetary_scaled")):
        p25, p50, p75 = q[src]
        if p50 is None:
            out = out.withColumn(dst, F.lit(None).cast("double"))
            continue
        spread = p75 - p25
        if spread == 0:
            spread = 1.0
        out = out.withColumn(dst, (F.col(src) - F.lit(p50)) / F.lit(spread))
    return out.drop("_r", "_f", "_m")


def build_rfm(sales: DataFrame, kind: str = "transactional") -> DataFrame:
    """D4/D5 + D6: the customer table with the three scaled columns."""
    return robust_scale(rfm_table(sales, kind))


# ── D7–D8 ───────────────────────────────────────────────────────────────────

def build_baskets(sales: DataFrame, kind: str = "transactional", keep_singles: bool = False,
                  label: str | None = None) -> DataFrame:
    """Items per basket; baskets of one line dropped unless asked.

    Transactional: product names (else ids) per (customer, transaction or date).
    Review/catalog: distinct categories per customer.
    One grouped aggregate: ``collect_set`` combines map-side, so a basket row
    holds at most one entry per catalogue item however many lines its key has
    (a hot basket cannot grow with the row count). Output: customer_id,
    basket_key, items (distinct, sorted), n_lines (lines in the basket, the
    reference's list length) and ``_ord`` (first line) when the input has it.
    """
    has_ord = "_ord" in sales.columns
    if kind == "transactional":
        label = label or ("product_name" if "product_name" in sales.columns else "product_id")
        key = F.col("transaction_id" if "transaction_id" in sales.columns else "date").cast("string")
    else:
        label = label or "category"
        key = F.col("customer_id")
    items = F.array_sort(F.collect_set(label))
    n_lines = F.count(F.lit(1)) if kind == "transactional" else F.size(items)
    aggs = [items.alias("items"), n_lines.cast("bigint").alias("n_lines")]
    if has_ord:
        aggs.append(F.min("_ord").alias("_ord"))
    # a line without its key belongs to no basket: all of them together would be one
    out = (sales.filter(F.col(label).isNotNull() & key.isNotNull() & F.col("customer_id").isNotNull())
                .groupBy("customer_id", key.alias("basket_key")).agg(*aggs))
    if not keep_singles:
        out = out.filter(F.col("n_lines") > 1)
    return out


def build_pruned_baskets(sales: DataFrame, min_support: float, kind: str = "transactional", label: str | None = None) -> DataFrame:
    """D7 for mining: the baskets of two items and more, each with only its items of ``min_support`` or more.

    Items are counted before any basket is put together: lines become distinct (basket, item) pairs, the pairs of items
    below the support are dropped by a join with the items that reach it, and what is left is collected. A basket
    then holds (mean basket size / ``min_support``) items at most, whatever the catalogue. Every basket that counts for the
    support has a row, without items if none of its own is left; ``n_items`` tells how many it had. For every
    support from ``min_support`` up the itemsets are those of ``build_baskets``.
    """
    if kind == "transactional":
        label = label or ("product_name" if "product_name" in sales.columns else "product_id")
        key = F.col("transaction_id" if "transaction_id" in sales.columns else "date").cast("string")
    else:
        label, key = label or "category", F.col("customer_id")
    basket = ["customer_id", "basket_key"]
    pairs = scratch_table(sales.select("customer_id", key.alias("basket_key"), F.col(label).alias("item")).na.drop().distinct(), "basket-items")
    sizes = pairs.groupBy(*basket).agg(F.count("*").alias("n_items")).where("n_items > 1")
    counted = scratch_table(pairs.join(sizes, basket), "basket-counted")
    n = sizes.agg(F.count("*").alias("n")).scalar()
    often = counted.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") / n >= F.lit(min_support) - 1e-12).select("item")
    # 1 / min_support times the mean basket size is the most there can be of them
    left = counted.join(often, "item", "left_semi").groupBy(*basket).agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast(left.schema["items"].dataType)
    return sizes.join(left, basket, "left").select(*basket, F.coalesce("items", none).alias("items"), "n_items")
