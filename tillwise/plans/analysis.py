"""The whole upload → insight run as one composition of the operators.

``analyse`` takes a raw sales DataFrame (any of the three dataset kinds, raw
column names), runs every stage the reference runs for an upload and returns
the result tables. The clean table and the customer table are materialised
once and shared; everything else stays lazy until the caller writes or reads
it (``write_insights`` writes all of them per job).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import by_job as J
from ..operators import clean as C
from ..operators import features as D
from ..operators import forecast as I
from ..operators import geo as H
from ..operators import report as K
from ..operators import rules as G
from ..operators import schema as A
from ..operators import segment as S
from ..operators import stats as E
from .prepare import materialize


@dataclass
class Analysis:
    dataset_type: str
    column_map: dict[str, str]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    n_clusters: int = 0
    silhouette: float = 0.0
    rules_found: int = 0
    mining_mode: str = "empty"


def analyse(raw: DataFrame, focus: str = "general", segmentation: str = "mixture",
            fuzzy_columns: bool = True, job_id: str = "job") -> Analysis:
    """Run A → K over one raw sales table.

    ``segmentation``: "mixture" (F1 BIC sweep, the reference's method) or
    "quantile" (F12, deterministic).
    """
    raw = C.with_order(raw)
    df = A.canonicalise(raw, fuzzy=fuzzy_columns)
    mapping = {c: c for c in df.columns if c in A.CANONICAL_ALIASES}
    kind = A.detect_dataset_type(df.columns)
    A.check_kind_columns(df.columns, kind)
    rows = C.unpack_packed_rows(df) if kind == "review" else df
    # typed once; the filters, the counts and the fence passes all read the kept rows
    typed = materialize(C.coerce_types(C.clean_string_formats(rows)), f"{job_id}-typed")
    clean = materialize(D.engineer_features(C.clean_rows(typed, kind), kind), f"{job_id}-clean")
    A.enforce_admission(A.admission(df, clean, unpacked=typed))
    df = typed

    out = Analysis(kind, mapping)
    t = out.tables
    t["summary"] = E.dataset_summary(clean, kind, raw=df)

    rfm = materialize(D.build_rfm(clean, kind), f"{job_id}-rfm")
    if segmentation == "mixture":
        labelled, profiles, sweep = S.segment_by_mixture(rfm)
        out.n_clusters = sweep.best.k
    else:
        labelled, profiles = S.segment_by_quantiles(rfm)
        out.n_clusters = profiles.count()
    labelled = materialize(labelled, f"{job_id}-segments")
    out.silhouette = S.silhouette_sq_euclidean(labelled)
    t["customers"] = labelled
    t["segments"] = profiles
    t["segment_comparison"] = S.segment_comparison(profiles)
    t["customer_map"] = S.map_scaled(S.customer_map(labelled))

    baskets = D.build_baskets(clean, kind)
    mined = G.run_rules(baskets, clean if kind == "transactional" else None,
                        baskets_all=D.build_baskets(clean, kind, keep_singles=True))
    out.rules_found, out.mining_mode = mined.total_found, mined.mining_mode
    t["rules"] = mined.rules

    d, r = E.trend_columns(clean)
    if d is not None and r is not None:
        monthly = E.monthly_revenue(clean)
        t["monthly_revenue"] = monthly
        t["category_monthly"] = E.category_monthly(clean) if "category" in clean.columns else None
        t["top_products"] = E.top_products(clean, units="quantity" in clean.columns) if "product_name" in clean.columns else None
        t["mom_growth"] = E.mom_growth(monthly)
        status, fc, hist = I.forecast(I.resolve_input(clean))
        t["forecast_status"], t["forecast"], t["forecast_history"] = status, fc, hist
    else:
        monthly = None
        t["top_products"] = E.static_top_products(clean)
        t["category_revenue"] = E.static_category_revenue(clean) if "category" in clean.columns else None

    geo = H.run_geo(clean)
    if geo is not None:
        t.update({f"geo_{k}": v for k, v in geo.items()})
        t["geo_segments"] = H.segments_per_region(H.clean_geo(clean, H.find_geo_column(clean)), labelled)

    t["stats"] = E.full_stats(clean, kind, raw=df, segments_found=out.n_clusters, silhouette=out.silhouette,
                              rules_found=out.rules_found, mining_mode=out.mining_mode)

    t["report"] = _report(t, profiles, mined.rules, monthly, out.silhouette, focus, job_id)
    out.tables = {k: v for k, v in t.items() if v is not None}
    return out


def _report(t: dict, profiles: DataFrame, rules: DataFrame, monthly: DataFrame | None, silhouette: float,
            focus: str, job_id: str) -> DataFrame:
    spark = profiles.sparkSession
    job = F.lit(job_id)
    summary = t["summary"]
    # fields a kind's summary lacks read as the report's defaults ("N/A" text, 0 money)
    defaults = {"total_transactions": (None, "bigint"), "date_start": ("N/A", "string"),
                "date_end": ("N/A", "string"), "total_revenue": (0.0, "double"),
                "avg_order_value": (0.0, "double")}
    for c, (value, typ) in defaults.items():
        if c not in summary.columns:
            summary = summary.withColumn(c, F.lit(value).cast(typ))
    mon = monthly if monthly is not None else spark.createDataFrame([], "month string, total_revenue double")
    top = t.get("top_products")
    if top is None:
        top = spark.createDataFrame([], "product_name string, total_revenue double, rank int")
    cats, share = t.get("category_monthly"), t.get("category_revenue")
    return K.build_report(
        summary.withColumn("job_id", job), profiles.withColumn("job_id", job), rules.withColumn("job_id", job),
        mon.withColumn("job_id", job), top.withColumn("job_id", job),
        spark.range(1).select(job.alias("job_id"), F.lit(float(silhouette)).alias("score")),
        spark.range(1).select(job.alias("job_id"), F.lit(focus).alias("focus")),
        None if cats is None else cats.select("category").withColumn("job_id", job),
        None if share is None else share.withColumn("job_id", job))


def analyse_jobs(raw: DataFrame, job_col: str, focus: str = "general", fuzzy_columns: bool = True, k: int = 4,
                 min_rows: int = 100, min_clean: int = 10) -> dict[str, DataFrame]:
    """Run A → K for every job of a transactional table at once; each result table is keyed by ``job_id``.

    ``job_col`` tells the uploads apart; their columns must be the same. Segments are the quantile segments
    (F12) of each job. A job's rows equal those of ``analyse`` over its own lines. A job of which too few rows are left
    (A6) has ``admitted`` false in table ``jobs`` and no other rows.
    """
    lines = C.with_order(raw.where(F.col(job_col).isNotNull()))
    placed = F.struct(F.col(job_col).cast("string").alias("job"), F.col("_ord").alias("at"))
    df = A.canonicalise(lines.withColumn("_ord", placed).drop(job_col), fuzzy=fuzzy_columns).withColumn(J.JOB, F.col("_ord.job"))
    kind = A.detect_dataset_type(df.columns)
    if kind != "transactional":
        raise ValueError(f"many jobs in one run need transactional data, these columns read as {kind}")
    typed = materialize(C.coerce_types(C.clean_string_formats(df)), "jobs-typed")
    clean = materialize(D.engineer_features(J.clean_rows(typed, kind), kind), "jobs-clean")
    counts = typed.groupBy(J.JOB).agg(F.count(F.lit(1)).alias("rows_in")).join(
        clean.groupBy(J.JOB).agg(F.count(F.lit(1)).alias("rows_kept"), F.count_distinct("customer_id").alias("customers")), J.JOB, "left")
    t = {"jobs": counts.fillna(0).withColumn("admitted", (F.col("rows_in") >= min_rows) & (F.col("rows_kept") >= min_clean)
                                             & (F.col("customers") >= S.MIN_CUSTOMERS))}
    admitted = t["jobs"].where("admitted").select(J.JOB)
    clean = clean.join(admitted, J.JOB, "left_semi")
    t["summary"] = J.summary(clean, typed)
    rfm = materialize(J.rfm_table(clean, kind), "jobs-rfm")
    labelled, t["segments"] = J.quantile_segments(J.robust_scale(rfm), k)
    t["customers"] = materialize(labelled, "jobs-segments")
    t["silhouette"] = J.silhouette(t["customers"])
    t["rules"] = materialize(J.run_rules(J.baskets(clean, kind), clean), "jobs-rules")
    t["monthly_revenue"] = J.monthly_revenue(clean)
    t["mom_growth"] = J.mom_growth(t["monthly_revenue"])
    if "category" in clean.columns:
        t["category_monthly"] = J.category_months(clean)
    if "product_name" in clean.columns:
        t["top_products"] = J.top_products(clean)
    if "region" in clean.columns:
        t["geo_region_stats"] = J.region_stats(H.clean_geo(clean, "region"))
    t["forecast_status"], t["forecast"], t["forecast_history"] = (
        x.withColumnRenamed("series_key", J.JOB) for x in I.forecast(I.resolve_input(clean, J.JOB)))
    spark = raw.sparkSession
    focused = t["summary"].select(J.JOB, F.lit(focus).alias("focus"))
    top = t.get("top_products")
    if top is None:
        top = spark.createDataFrame([], "job_id string, product_name string, total_revenue double, rank int")
    cats = t.get("category_monthly")
    t["report"] = K.build_report(t["summary"], t["segments"], t["rules"], t["monthly_revenue"], top, t["silhouette"], focused,
                                 None if cats is None else cats.select(J.JOB, "category"))
    return t


def write_analysis(result: Analysis, out_dir: str, job_id: str) -> dict[str, str]:
    """K2: every result table of a job as one committed run; ``report.read_committed`` reads them back."""
    return K.commit_run(result.tables, out_dir, job_id)
