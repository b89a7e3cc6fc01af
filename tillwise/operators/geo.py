"""H: geography — region pick and cleaning, region stats, shares, growth,
concentration, home regions, products per region, map name aliases.

Per-region work is one grouped plan each (no loop over regions). Global
windows (shares, running share, ranks) only run on the per-region table, whose
size is the number of regions, never on the line table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions.ranking import ranked
from ..session import scratch_table
from .clean import with_order

# ── Fixed values (must equal the reference's) ───────────────────────────────
# Raw column names tried, in order, when the canonical region column is absent
# or has fewer than two values.
RAW_GEO_NAMES = ["country", "state", "city", "province", "location", "area", "territory", "zone",
                 "market", "geo", "geography", "place", "customer_location", "Country", "State",
                 "City", "Location"]
# Map names: title-cased region → name used by the world map.
COUNTRY_NAME_MAP = {
    "United Kingdom": "United Kingdom", "Uk": "United Kingdom",
    "Usa": "United States of America", "United States": "United States of America",
    "Us": "United States of America", "Uae": "United Arab Emirates", "Eire": "Ireland",
    "Channel Islands": "United Kingdom", "Rsa": "South Africa", "Korea": "South Korea",
    "Czech Republic": "Czechia", "Hong Kong": "China",
}
# HHI thresholds and labels.
HHI_HIGH, HHI_MODERATE = 2500, 1500
HHI_LABELS = {
    "high": ("Highly concentrated", "Revenue is dominated by a small number of regions."),
    "moderate": ("Moderately concentrated", "A few regions drive most of the revenue."),
    "low": ("Competitive", "Revenue is spread relatively evenly across regions."),
}
MIN_GEO_ROWS = 5
# A raw column with more values than this is no geography.
MAX_GEO_VALUES = 500
REVENUE_CANDIDATES = ["revenue", "total_sales", "total_revenue", "amount", "price"]
DATE_CANDIDATES = ["date", "invoice_date", "order_date", "purchase_date", "created_at"]
PRODUCT_CANDIDATES = ["product_name", "product_id", "item_name", "product", "item"]
# ─────────────────────────────────────────────────────────────────────────────

#: Standard error of the sketch of distinct values, and how far from the bound (ten of them) it is believed.
SKETCH_ERROR, SKETCH_MARGIN = 0.02, 0.2


def _first(df: DataFrame, names: list[str]) -> str | None:
    return next((c for c in names if c in df.columns), None)


def find_geo_column(df: DataFrame) -> str | None:
    """H1: ``region`` when it has ≥ 2 values, else the first raw name with 2..500.

    One scan gives every candidate's least and greatest value, which settle "two or more" exactly, and a sketch of its number of
    values. Values are counted only where the sketch is too near the bound to tell.
    """
    cands = (["region"] if "region" in df.columns else []) + [c for c in RAW_GEO_NAMES if c in df.columns]
    if not cands:
        return None
    col = {c: F.col(f"`{c}`") for c in cands}
    facts = df.agg(*[x.alias(f"{n}{i}") for i, c in enumerate(cands) for n, x in (
        ("two", F.min(col[c]) < F.max(col[c])), ("about", F.approx_count_distinct(col[c], SKETCH_ERROR)))]).first()
    for i, c in enumerate(cands):
        if not facts[f"two{i}"]:
            continue
        about = facts[f"about{i}"]
        if c == "region" or about <= MAX_GEO_VALUES * (1 - SKETCH_MARGIN):
            return c
        if about < MAX_GEO_VALUES * (1 + SKETCH_MARGIN):
            n = df.select(col[c].alias("v")).where("v IS NOT NULL").distinct().limit(MAX_GEO_VALUES + 1).count()
            if n <= MAX_GEO_VALUES:
                return c
    return None


def clean_geo(df: DataFrame, geo_col: str = "region") -> DataFrame:
    """H2: trimmed, title-cased region in column ``region``; placeholders dropped."""
    titled = T.title_case(F.trim(F.col(f"`{geo_col}`").cast("string")))
    titled = F.coalesce(titled, F.lit("None"))  # missing values read as 'None' and are dropped
    out = df.withColumn("region", titled)
    return out.filter(~F.col("region").isin(*T.GEO_PLACEHOLDERS))


def _revenue_col(df: DataFrame) -> str | None:
    return _first(df, REVENUE_CANDIDATES)


def region_stats(geo: DataFrame) -> DataFrame:
    """H3 + H4: per region revenue sum/mean, customers, rows, share and running share."""
    rev = _revenue_col(geo)
    aggs = []
    if rev:
        aggs += [F.round(F.sum(rev), 2).alias("total_revenue"), F.round(F.avg(rev), 2).alias("avg_order_value")]
    if "customer_id" in geo.columns:
        aggs.append(F.count_distinct("customer_id").cast("bigint").alias("unique_customers"))
    aggs.append(F.count(F.lit(1)).cast("bigint").alias("total_transactions"))
    # one row per region, kept: the total, the ranks and whatever is read of the result come from it, the lines are read once
    g = scratch_table(geo.groupBy("region").agg(*aggs), "regions")
    if not rev:
        return ranked(g, [F.col("total_transactions").desc(), F.col("region")])
    tot = g.agg(F.sum("total_revenue")).scalar()
    share = F.when(tot > 0, F.round(F.col("total_revenue") / tot * 100, 1)).otherwise(F.lit(0.0))
    out = ranked(g.withColumn("revenue_share_pct", share), [F.col("total_revenue").desc(), F.col("region")],
                 {"revenue_share_pct": "cumulative_share_pct"})
    return out.withColumn("cumulative_share_pct", F.round("cumulative_share_pct", 1))


def region_monthly(geo: DataFrame) -> DataFrame:
    """H5: revenue per (region, month)."""
    d, r = _first(geo, DATE_CANDIDATES), _revenue_col(geo)
    if d is None or r is None:
        return geo.sparkSession.createDataFrame([], "region string, month string, total_revenue double")
    return (geo.filter(F.col(d).isNotNull())
               .groupBy("region", N.month_str(F.col(d).cast("timestamp")).alias("month"))
               .agg(F.round(F.sum(r), 2).alias("total_revenue")))


def region_growth(geo: DataFrame) -> DataFrame:
    """H6: month-over-month change per region (null for a region's first month)."""
    m = region_monthly(geo)
    w = Window.partitionBy("region").orderBy("month")
    prev = F.lag("total_revenue").over(w)
    return m.select("region", "month", "total_revenue",
                    F.when(prev > 0, F.round((F.col("total_revenue") - prev) / prev * 100, 1)).alias("growth_pct"))


def top_regions(stats: DataFrame, n: int = 10) -> DataFrame:
    """H7: first n regions by revenue."""
    return stats.filter(F.col("rank") <= n)


def home_regions(geo: DataFrame) -> DataFrame:
    """Each customer's first region in input order (map-side ``min_by``)."""
    geo = with_order(geo)
    return geo.groupBy("customer_id").agg(F.min_by("region", F.col("_ord")).alias("region"))


def customers_per_region(geo: DataFrame, n: int = 20) -> DataFrame:
    """H8: customers per home region, top n."""
    g = home_regions(geo).groupBy("region").agg(F.count(F.lit(1)).cast("bigint").alias("customer_count"))
    w = Window.orderBy(F.col("customer_count").desc(), F.col("region"))
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def segments_per_region(geo: DataFrame, segments: DataFrame) -> DataFrame:
    """H9: customers per (home region, segment label); ``segments``: customer_id, label."""
    homes = home_regions(geo)
    return (homes.join(segments.select("customer_id", "label"), "customer_id")
                 .groupBy("region", "label").agg(F.count(F.lit(1)).cast("bigint").alias("customers")))


def products_per_region(geo: DataFrame, n_regions: int = 10, n_products: int = 5) -> DataFrame:
    """For the regions with the most rows, their top products by revenue."""
    p, r = _first(geo, PRODUCT_CANDIDATES), _revenue_col(geo)
    counts = geo.groupBy("region").agg(F.count(F.lit(1)).alias("_rows"))
    wr = Window.orderBy(F.col("_rows").desc(), F.col("region"))
    top = counts.withColumn("region_rank", F.row_number().over(wr)).filter(F.col("region_rank") <= n_regions)
    prod = (geo.join(top.select("region", "region_rank"), "region", "left_semi")
               .groupBy("region", F.col(p).alias("product_name")).agg(F.sum(r).alias("_v")))
    wp = Window.partitionBy("region").orderBy(F.col("_v").desc(), F.col("product_name"))
    ranked = prod.withColumn("product_rank", F.row_number().over(wp)).filter(F.col("product_rank") <= n_products)
    return ranked.join(top.select("region", "region_rank"), "region").select(
        "region", "region_rank", "product_rank", "product_name", F.round("_v", 2).alias("total_revenue"))


def market_concentration(stats: DataFrame) -> DataFrame:
    """HHI of the rounded shares, label, top-1 / top-3 share, region count."""
    hhi = F.round(F.sum(F.col("revenue_share_pct") * F.col("revenue_share_pct")), 1)
    agg = stats.agg(
        hhi.alias("hhi"),
        F.round(F.sum(F.when(F.col("rank") == 1, F.col("revenue_share_pct"))), 1).alias("top1_share"),
        F.round(F.sum(F.when(F.col("rank") <= 3, F.col("revenue_share_pct"))), 1).alias("top3_share"),
        F.count(F.lit(1)).cast("bigint").alias("n_regions"),
    )
    level = F.when(F.col("hhi") > HHI_HIGH, "high").when(F.col("hhi") > HHI_MODERATE, "moderate").otherwise("low")
    label = F.when(level == "high", HHI_LABELS["high"][0]).when(level == "moderate", HHI_LABELS["moderate"][0])\
             .otherwise(HHI_LABELS["low"][0])
    desc = F.when(level == "high", HHI_LABELS["high"][1]).when(level == "moderate", HHI_LABELS["moderate"][1])\
            .otherwise(HHI_LABELS["low"][1])
    return agg.select("hhi", label.alias("label"), desc.alias("description"), "top1_share", "top3_share", "n_regions")


def geo_summary(geo: DataFrame, stats: DataFrame, conc: DataFrame, geo_col: str = "region") -> DataFrame:
    """Region count, leader with its revenue and share, HHI and label."""
    lead = stats.filter(F.col("rank") == 1).select(
        F.col("region").alias("top_region"), F.col("total_revenue").alias("top_region_revenue"),
        F.col("revenue_share_pct").alias("top_region_share"))
    n = geo.select(F.count_distinct("region").cast("bigint")).scalar()
    c = conc.select(F.col("hhi"), F.col("label").alias("concentration_label"))
    return lead.select(n.alias("total_regions"), "*",
                       c.select("hhi").scalar().alias("hhi"),
                       c.select("concentration_label").scalar().alias("concentration_label"),
                       F.lit(geo_col).alias("geo_column_used"))


def map_regions(stats: DataFrame) -> DataFrame:
    """Map name (word-capitalised, 12 aliases) and colour tier 0..5 by rank."""
    alias = F.create_map(*[x for kv in COUNTRY_NAME_MAP.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    titled = F.initcap(F.trim(F.col("region")))
    total = stats.agg(F.count(F.lit(1))).scalar()
    tier = F.least(F.lit(5), F.floor((F.col("rank") - 1) / F.greatest(total, F.lit(1)) * 6)).cast("int")
    return stats.select("region", F.coalesce(F.element_at(alias, titled), titled).alias("map_name"),
                        "rank", tier.alias("tier"))


def run_geo(sales: DataFrame) -> dict[str, DataFrame] | None:
    """All H results for one clean sales table (None when no geography)."""
    col = find_geo_column(sales)
    if col is None:
        return None
    geo = clean_geo(sales, col)
    if geo.limit(MIN_GEO_ROWS).count() < MIN_GEO_ROWS:
        return None
    stats = region_stats(geo)
    conc = market_concentration(stats)
    return {
        "region_stats": stats, "region_growth": region_growth(geo), "top_regions": top_regions(stats),
        "regional_customers": customers_per_region(geo), "regional_products": products_per_region(geo),
        "market_concentration": conc, "summary": geo_summary(geo, stats, conc, col),
        "map_regions": map_regions(stats),
    }
