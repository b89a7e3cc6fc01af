"""K1 over many tenants: an upload's whole analysis keyed by ``job_id``, all jobs in one run.

Every stage is a grouped form of the operator for one table, with the same results per job. A job may be a
handful of rows or a third of them: sums combine on the map side, exact quantiles come from range partitions
(``grouped_quantiles``), ranks are windows over already aggregated rows of a job, and the customers, lines and baskets of a
job are spread over partitions by customer or basket, never gathered by job.

Rules: items below their job's support are dropped first, so a basket keeps at most (mean basket size / support) kinds of
items. Parallel FP-growth then runs over the items tagged with their job, once per class of jobs whose wanted count
lies in the same power of two, so that its threshold is at most twice too low for any job.

Rows without a job id belong to no job and are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions.quantile import grouped_quantiles
from ..session import scratch_table
from . import clean as C
from . import features as D
from . import rules as G
from . import segment as S
from .schema import check_kind_columns

JOB = "job_id"
BY = (JOB,)
_TAG = "\u0001"


# ── C: cleaning ──────────────────────────────────────────────────────────────

def fences(df: DataFrame, col: str = "price", k: float = 3.0) -> DataFrame:
    """C4 per job: (job_id, q1, q3, low, high), exact."""
    q = grouped_quantiles(df, [JOB], [col], [0.25, 0.75]).select(JOB, F.col(f"{col}_q0").alias("q1"), F.col(f"{col}_q1").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"low": F.col("q1") - F.lit(k) * iqr, "high": F.col("q3") + F.lit(k) * iqr})


def before_fences(df: DataFrame, kind: str) -> DataFrame:
    """C2 and C3 per job: the rows that the fences are made of."""
    return C.positive_filter(C.drop_missing(df.where(F.col(JOB).isNotNull()), kind), kind)


def clean_rows(df: DataFrame, kind: str, iqr_k: float = 3.0, cut: DataFrame | None = None) -> DataFrame:
    """C2–C7 per job, in the order of ``clean.clean_rows``; ``cut``: the fences of these rows, where they are known.

    The fences come from a written table of one row per job. Spark sees its size and leaves the lines where they are, unless
    there are so many jobs that both sides have to move.
    """
    check_kind_columns(df.columns, kind)
    if kind == "transactional":
        df = before_fences(df, kind)
        cut = (fences(df, "price", iqr_k) if cut is None else cut).select(JOB, "low", "high")
        return df.join(cut, JOB).where(F.col("price").between(F.col("low"), F.col("high"))).select(*df.columns)
    df = C.drop_missing(df.where(F.col(JOB).isNotNull()), kind)
    if kind == "review":
        return C.rating_range_filter(C.dedupe_keep_first(C.placeholder_filter(df), (JOB, "customer_id", "product_id")))
    return C.positive_filter(df, kind)


# ── D: customers and baskets ─────────────────────────────────────────────────

def _distinct_per(df: DataFrame, by: list[str], *cols: str) -> DataFrame:
    """(by, n): distinct known values; an aggregate of its own, as several in one would repeat every row."""
    return df.select(*by, *cols).na.drop(subset=list(cols)).distinct().groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def rfm_table(sales: DataFrame, kind: str) -> DataFrame:
    """D4/D5 per job: job_id, customer_id, frequency, monetary, recency."""
    who = [JOB, "customer_id"]
    if kind == "transactional":
        freq = "transaction_id" if "transaction_id" in sales.columns else "date"
        base = sales.groupBy(*who).agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("monetary"), F.max("date").alias("_last"))
        until = sales.groupBy(JOB).agg((F.max("date") + F.expr("INTERVAL 1 DAY")).alias("_until"))
        recency = N.elapsed_days(F.col("_until"), F.col("_last"))
        counts = _distinct_per(sales, who, freq)
        return (base.join(counts, who, "left").join(until, JOB)
                .select(*who, F.coalesce("n", F.lit(0)).cast("bigint").alias("frequency"), "monetary", recency.alias("recency")))
    aggs = [F.sum("revenue").alias("monetary")]
    if "rating" in sales.columns:
        aggs.append(F.avg("rating").alias("_rating"))
    base = sales.groupBy(*who).agg(*aggs).join(_distinct_per(sales, who, "product_id"), who, "left")
    raw = F.greatest((F.lit(5.0) - F.col("_rating")) * 20, F.lit(0.0)) if "rating" in sales.columns else None
    recency = F.lit(50.0) if raw is None else F.when(F.col("_rating").isNotNull(), F.bround(raw, 0))
    return base.select(*who, F.coalesce("n", F.lit(0)).cast("bigint").alias("frequency"), F.coalesce("monetary", F.lit(0.0)).alias("monetary"),
                       F.coalesce(recency.cast("double"), F.lit(0.0)).alias("recency"))


def robust_scale(rfm: DataFrame) -> DataFrame:
    """D6 per job."""
    feats = D.scale_features(rfm)
    q = grouped_quantiles(feats, [JOB], ["_r", "_f", "_m"], [0.25, 0.5, 0.75])
    out = feats.join(q, JOB)
    for src, dst in (("_r", "recency_scaled"), ("_f", "frequency_scaled"), ("_m", "monetary_scaled")):
        spread = F.col(f"{src}_q2") - F.col(f"{src}_q0")
        out = out.withColumn(dst, (F.col(src) - F.col(f"{src}_q1")) / F.when(spread == 0, F.lit(1.0)).otherwise(spread))
    return out.select(*rfm.columns, *S.FEATURES)


def baskets(sales: DataFrame, kind: str, keep_singles: bool = False, label: str | None = None) -> DataFrame:
    """D7/D8 per job: a basket never spans jobs."""
    own = F.to_json(F.struct(F.col(JOB).alias("j"), F.col("customer_id").alias("c")))
    known = sales.where(F.col("customer_id").isNotNull())
    out = D.build_baskets(known.withColumn("customer_id", own), kind, keep_singles, label)
    parts = F.from_json("customer_id", "j string, c string")
    key = F.col("basket_key") if kind == "transactional" else parts["c"]
    return out.withColumn(JOB, parts["j"]).withColumns({"customer_id": parts["c"], "basket_key": key})


# ── F: segments ──────────────────────────────────────────────────────────────

def quantile_segments(rfm: DataFrame, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """F12 → F3 → F6/F7 per job: (customers with cluster and label, profiles)."""
    scored = S.composite_score(rfm)
    cuts = grouped_quantiles(scored, [JOB], ["score"], [j / k for j in range(1, k)])
    above = sum((F.when(F.col("score") > F.col(f"score_q{i}"), 1).otherwise(0) for i in range(k - 1)), F.lit(0))
    comp = scored.join(cuts, JOB).select(*scored.columns, above.cast("int").alias("component"))
    lab = S.renumber_clusters(comp, by=BY)
    prof = S.cluster_profiles(lab, BY)
    return S.label_customers(lab, prof, BY), prof


def silhouette(labelled: DataFrame) -> DataFrame:
    """F4 per job: (job_id, score), squared Euclidean, from one row of sums per cluster."""
    x = [F.col(c) for c in S.FEATURES]
    square = sum((c * c for c in x), F.lit(0.0))
    sums = labelled.groupBy(JOB, "cluster").agg(F.count("*").alias("n"), F.sum(square).alias("q"),
                                                *[F.sum(c).alias(f"s{i}") for i, c in enumerate(S.FEATURES)])
    of_job = sums.groupBy(JOB).agg(F.collect_list(F.struct("cluster", "n", "q", "s0", "s1", "s2")).alias("clusters"))  # 8 at most
    points = labelled.select(JOB, "cluster", *x).join(of_job, JOB).withColumn("_sq", square)

    def total(c: Column) -> Column:
        return c["n"] * F.col("_sq") + c["q"] - 2 * (x[0] * c["s0"] + x[1] * c["s1"] + x[2] * c["s2"])

    own = F.filter("clusters", lambda c: c["cluster"] == F.col("cluster"))[0]
    away = F.array_min(F.transform(F.filter("clusters", lambda c: c["cluster"] != F.col("cluster")), lambda c: total(c) / c["n"]))
    near = total(own) / (own["n"] - 1)
    score = F.when((own["n"] <= 1) | away.isNull(), F.lit(0.0)).when(near < away, 1 - near / away).when(near > away, away / near - 1).otherwise(0.0)
    return points.select(JOB, score.alias("s")).groupBy(JOB).agg(F.avg("s").alias("score"))


# ── E: summary and trends ────────────────────────────────────────────────────

def summary(sales: DataFrame, raw: DataFrame) -> DataFrame:
    """E1 per job for transactional data; ``raw``: the rows before cleaning."""
    freq = "transaction_id" if "transaction_id" in sales.columns else "date"
    out = sales.groupBy(JOB).agg(
        F.count(F.lit(1)).alias("_kept"), F.round(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("total_revenue"),
        F.round(F.avg("revenue"), 2).alias("avg_order_value"), N.day_str(F.min("date")).alias("date_start"),
        N.day_str(F.max("date")).alias("date_end"))
    out = out.join(raw.groupBy(JOB).agg(F.count(F.lit(1)).alias("_rows")), JOB)
    for name, col in (("total_customers", "customer_id"), ("total_products", "product_id"), ("total_transactions", freq)):
        if col in sales.columns:
            out = out.join(_distinct_per(sales, [JOB], col).withColumnRenamed("n", name), JOB, "left")
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint") if col in sales.columns else F.lit(0).cast("bigint"))
    return out.select(JOB, "total_customers", "total_products", (F.col("_rows") - F.col("_kept")).cast("bigint").alias("rows_removed"),
                      F.lit("transactional").alias("dataset_type"), "total_transactions", "total_revenue", "avg_order_value",
                      "date_start", "date_end")


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """E6 per job."""
    return (sales.groupBy(JOB, N.month_str(F.col("date").cast("timestamp")).alias("month"))
            .agg(F.round(F.sum("revenue"), 2).alias("total_revenue")).where("month IS NOT NULL"))


def category_months(sales: DataFrame) -> DataFrame:
    """E7 per job."""
    return (sales.groupBy(JOB, "category", N.month_str(F.col("date").cast("timestamp")).alias("month"))
            .agg(F.round(F.sum("revenue"), 2).alias("revenue")).where("month IS NOT NULL"))


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    """E8 per job, with the units sold."""
    g = sales.groupBy(JOB, "product_name").agg(F.sum("revenue").alias("_v"), F.sum("quantity").cast("bigint").alias("total_quantity"))
    w = Window.partitionBy(JOB).orderBy(F.col("_v").desc(), F.col("product_name"))
    return (g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(JOB, "rank", "product_name", F.round("_v", 2).alias("total_revenue"), "total_quantity"))


def mom_growth(monthly: DataFrame) -> DataFrame:
    """E9 per job."""
    w = Window.partitionBy(JOB).orderBy("month")
    change = F.when(F.col("_prev") > 0, F.round((F.col("total_revenue") - F.col("_prev")) / F.col("_prev") * 100, 1))
    lagged = monthly.withColumn("_prev", F.lag("total_revenue").over(w)).select(JOB, "month", change.alias("g"))
    return lagged.groupBy(JOB).agg(F.coalesce(F.max_by("g", "month"), F.lit(0.0)).alias("mom_growth_pct"))


# ── H: geography ─────────────────────────────────────────────────────────────

def region_stats(geo: DataFrame) -> DataFrame:
    """H3 + H4 per job: revenue, customers, rows, share, running share and rank of every region; one scan for the sums."""
    g = geo.groupBy(JOB, "region").agg(F.round(F.sum("revenue"), 2).alias("total_revenue"), F.round(F.avg("revenue"), 2).alias("avg_order_value"),
                                       F.count(F.lit(1)).cast("bigint").alias("total_transactions"))
    g = g.join(_distinct_per(geo, [JOB, "region"], "customer_id").withColumnRenamed("n", "unique_customers"), [JOB, "region"], "left")
    of_job = Window.partitionBy(JOB)
    total = F.sum("total_revenue").over(of_job)
    g = g.withColumn("revenue_share_pct", F.when(total > 0, F.round(F.col("total_revenue") / total * 100, 1)).otherwise(F.lit(0.0)))
    order = of_job.orderBy(F.col("total_revenue").desc(), F.col("region"))
    return g.select(JOB, "region", "total_revenue", "avg_order_value", F.coalesce("unique_customers", F.lit(0)).alias("unique_customers"),
                    "total_transactions", "revenue_share_pct", F.row_number().over(order).alias("rank"),
                    F.round(F.sum("revenue_share_pct").over(order.rowsBetween(Window.unboundedPreceding, 0)), 1).alias("cumulative_share_pct"))


# ── G: rules ─────────────────────────────────────────────────────────────────

def _levels(value: str, wanted: float, steps: list[float]) -> Column:
    """The first of the relaxed thresholds that a job's best value reaches, null if none."""
    out = F.lit(None).cast("double")
    for step in reversed(steps):
        out = F.when(F.col(value) >= F.lit(wanted * step), F.lit(wanted * step)).otherwise(out)
    return out


def mine_rules(tx: DataFrame, min_support: float, min_confidence: float, top_n: int, mode: str) -> DataFrame:
    """G2–G5 per job on baskets (job_id, items): ranked rules with each job's relaxed support and confidence.

    Jobs without enough baskets or without a rule are not in the result.
    """
    tx = scratch_table(G.normalise_baskets(tx).select(JOB, "items"), "job-baskets")
    n = tx.groupBy(JOB).agg(F.count("*").alias("n_tx")).where(F.col("n_tx") >= G.MIN_BASKETS)
    counts = tx.select(JOB, F.explode("items").alias("item")).groupBy(JOB, "item").agg(F.count("*").alias("freq")).join(n, JOB)
    counts = counts.withColumn("support", F.col("freq") / F.col("n_tx"))
    best = counts.groupBy(JOB).agg(F.max("support").alias("best"), F.first("n_tx").alias("n_tx"))
    level = best.select(JOB, "n_tx", _levels("best", min_support, G.SUPPORT_STEPS).alias("level")).where("level IS NOT NULL")
    # thresholds of a class lie within a factor of two of each other
    level = level.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("level") * F.col("n_tx") - 1e-6)))
    level = scratch_table(level.withColumn("size", F.floor(F.log2("need")).cast("int")), "job-levels")
    singles = scratch_table(counts.join(level.select(JOB, "level", "size"), JOB).where("support >= level"), "job-items")
    kept = singles.groupBy(JOB).agg(F.collect_set("item").alias("kept"), F.first("size").alias("size"))  # mean basket size / support at most
    pruned = tx.join(kept, JOB).withColumn("items", F.array_intersect("items", "kept")).where(F.size("items") > 1)
    pruned = scratch_table(pruned.select(JOB, "size", "items"), "job-pruned")
    itemsets = singles.select(JOB, F.array("item").alias("items"), "freq", "support")
    classes = level.groupBy("size").agg(F.min("need").alias("need")).orderBy("size").collect()  # a row per power of two
    for c in classes:
        some = pruned.where(F.col("size") == c["size"]).select(
            F.transform("items", lambda x: F.concat(F.col(JOB), F.lit(_TAG), x)).alias("items"))
        total = some.count()
        if not total:
            continue
        found = G.frequent_itemsets(some, (c["need"] - 0.5) / total).where(F.size("items") > 1)
        job = F.substring_index(F.col("items")[0], _TAG, 1)
        plain = F.array_sort(F.transform("items", lambda x: F.substr(x, F.instr(x, F.lit(_TAG)) + 1)))
        sets = found.select(job.alias(JOB), plain.alias("items"), "freq").join(level.select(JOB, "n_tx", "level"), JOB)
        sets = sets.select(JOB, "items", "freq", (F.col("freq") / F.col("n_tx")).alias("support"), "level").where("support >= level")
        itemsets = itemsets.unionByName(scratch_table(sets.drop("level"), "job-itemsets"))
    rules = scratch_table(G.generate_rules(itemsets, BY), "job-rules")
    settled = rules.groupBy(JOB).agg(F.max("confidence").alias("best")).select(
        JOB, _levels("best", min_confidence, G.CONFIDENCE_STEPS).alias("least"))
    rules = rules.join(settled, JOB).where("confidence >= least")
    rules = rules.withColumn("total_found", F.count("*").over(Window.partitionBy(JOB)))
    ranked = G.round_rules(G.rank_rules(rules, top_n, BY)).withColumn("mode", F.lit(mode))
    return ranked.select(JOB, "antecedents", "consequents", "support", "confidence", "lift", "rank", "mode", "total_found")


def popular_items(sales: DataFrame, label: str = "product_name", top_n: int = G.TOP_N, basket_key: str = "transaction_id") -> DataFrame:
    """G8 per job: items by line count, support over all baskets."""
    n = _distinct_per(sales, [JOB], "customer_id", basket_key)
    counts = (sales.where(F.col(label).isNotNull()).groupBy(JOB, F.col(label).cast("string").alias("item"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("freq")).join(n, JOB))
    w = Window.partitionBy(JOB).orderBy(F.col("freq").desc(), F.col("item"))
    support = F.round(F.col("freq") / F.col("n"), 4)
    top = counts.withColumn("total_found", F.least(F.count("*").over(Window.partitionBy(JOB)), F.lit(top_n)))
    return (top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .select(JOB, F.array().cast("array<string>").alias("antecedents"), F.array("item").alias("consequents"), support.alias("support"),
                    support.alias("confidence"), F.lit(1.0).alias("lift"), "rank", F.lit("popular_fallback").alias("mode"), "total_found"))


def run_rules(all_baskets: DataFrame, sales: DataFrame, label: str = "product_name", min_support: float = G.MIN_SUPPORT,
              min_confidence: float = G.MIN_CONFIDENCE, top_n: int = G.TOP_N) -> DataFrame:
    """G6 ladder per job: every rung mines only the jobs that no rung before settled."""
    tx = scratch_table(all_baskets.where("n_lines > 1").select(JOB, "items", "n_lines"), "job-tx")
    facts = tx.groupBy(JOB).agg(F.count("*").alias("n"), F.avg("n_lines").alias("size"),
                                F.avg(T.has_category_keyword(F.col("items")).cast("double")).alias("share"))
    facts = scratch_table(facts, "job-facts")
    rungs = [(tx, (F.col("n") >= G.PRODUCT_MODE_BASKETS) & (F.col("size") >= 2), min_support, min_confidence, "product"),
             (tx, F.col("share") >= 0.5, min_support, min_confidence, "category"),
             (G.first_word_baskets(tx), F.lit(True), min_support, min_confidence, "category"),
             (tx, F.col("n") >= G.MIN_BASKETS, min_support / 4, min_confidence / 2, "product")]
    open_jobs, out = facts, []
    for rows, fits, support, confidence, mode in rungs:
        asked = open_jobs.where(fits).select(JOB)
        if not asked.limit(1).count():
            continue
        found = scratch_table(mine_rules(rows.join(asked, JOB, "left_semi"), support, confidence, top_n, mode), "job-found")
        out.append(found)
        open_jobs = scratch_table(open_jobs.join(found.select(JOB).distinct(), JOB, "left_anti"), "job-open")
    unsettled = sales.select(JOB).distinct()
    for found in out:
        unsettled = unsettled.join(found.select(JOB).distinct(), JOB, "left_anti")
    result = popular_items(sales.join(unsettled, JOB, "left_semi"), label, top_n,
                           "transaction_id" if "transaction_id" in sales.columns else "date")
    for found in out:
        result = result.unionByName(found)
    return result
