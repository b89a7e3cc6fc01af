"""J: campaign scenarios — one table over target segment × discount × horizon.

The dashboard evaluates one slider state at a time; here every combination is
a row. Grids are generated with ``explode`` over parameter arrays (no join),
and the baseline is joined on the day index, so the work is
segments × discounts × horizon days, independent of the sales volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ── Fixed values (must equal the reference's) ───────────────────────────────
ALL_ELASTICITY = -1.2
BASE_ELASTICITY, ELASTICITY_SPAN = -0.6, 1.4
COST_FACTOR = 0.35
DAYS_PER_YEAR = 365
# ─────────────────────────────────────────────────────────────────────────────

DISCOUNTS = [0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50]
HORIZONS = [30, 60, 90, 120, 150, 180]


def js_round(c: Column, digits: int = 0) -> Column:
    """Round half toward +∞, as the dashboard's Math.round does."""
    f = 10 ** digits
    return F.floor(c * f + 0.5) / f


def segment_elasticity(profiles: DataFrame) -> DataFrame:
    """Per segment elasticity from its mean spend vs the mean over segments."""
    avg_m = F.avg("avg_monetary").over(Window.partitionBy())
    ratio = F.when(avg_m > 0, F.coalesce(F.col("avg_monetary"), avg_m) / avg_m).otherwise(F.lit(1.0))
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (ratio - 0.5)))
    e = js_round(F.lit(BASE_ELASTICITY) - F.lit(ELASTICITY_SPAN) * clamp, 2)
    return profiles.select("label", "size", "avg_monetary", e.alias("elasticity"))


def multiplier(elasticity: Column, discount_pct: Column) -> Column:
    """Revenue multiplier (1 − d)·(1 + |e|·d)."""
    d = discount_pct / 100.0
    return (1 - d) * (1 + F.abs(elasticity) * d)


def _targets(profiles: DataFrame) -> DataFrame:
    seg = segment_elasticity(profiles)
    total = F.sum("size").over(Window.partitionBy())
    per = seg.select(F.col("label").alias("target"), F.col("size").alias("target_customers"),
                     (F.col("size") / F.greatest(total, F.lit(1))).alias("target_pct"), "elasticity")
    everyone = profiles.agg(F.lit("all").alias("target"), F.sum("size").alias("target_customers"),
                            F.lit(1.0).alias("target_pct"), F.lit(ALL_ELASTICITY).alias("elasticity"))
    return per.unionByName(everyone)


def baseline_points(forecast: DataFrame | None, summary: DataFrame, horizon: int = max(HORIZONS)) -> DataFrame:
    """(step, value): the forecast's predicted values, else total revenue / 365 a day."""
    if forecast is not None:
        return forecast.filter(F.col("step") <= horizon).select("step", F.col("predicted").alias("value"))
    rate = summary.select((F.col("total_revenue") / DAYS_PER_YEAR).alias("v"))
    return rate.select(F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), F.col("v").alias("value"))


def scenario_days(profiles: DataFrame, baseline: DataFrame, discounts=tuple(DISCOUNTS),
                  horizons=tuple(HORIZONS)) -> DataFrame:
    """Per scenario and day: baseline and scenario revenue, and running sums."""
    grid = (_targets(profiles)
            .select("*", F.explode(F.array(*[F.lit(d) for d in discounts])).alias("discount_pct"))
            .select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
            .select("*", F.explode(F.sequence(F.lit(1), F.col("horizon"))).alias("step")))
    days = grid.join(baseline, "step")
    multi = multiplier(F.col("elasticity"), F.col("discount_pct"))
    days = days.withColumn("multi", multi) \
               .withColumn("sim", F.col("value") * F.col("target_pct") * F.col("multi")
                           + F.col("value") * (1 - F.col("target_pct")))
    w = Window.partitionBy("target", "discount_pct", "horizon").orderBy("step") \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn("cum_base", F.sum("value").over(w)).withColumn("cum_sim", F.sum("sim").over(w))


def scenario_totals(profiles: DataFrame, baseline: DataFrame, avg_order_value: Column | float,
                    discounts=tuple(DISCOUNTS), horizons=tuple(HORIZONS)) -> DataFrame:
    """J4 + J5: totals, lift, cost, ROI and break-even day per scenario."""
    aov = avg_order_value if isinstance(avg_order_value, Column) else F.lit(float(avg_order_value))
    days = scenario_days(profiles, baseline, discounts, horizons)
    cost = js_round(F.col("target_customers") * aov * F.col("discount_pct") / 100.0 * COST_FACTOR)
    days = days.withColumn("discount_cost", cost)
    agg = days.groupBy("target", "discount_pct", "horizon").agg(
        F.sum("value").alias("_base"), F.sum("sim").alias("_sim"),
        F.first("target_customers").alias("target_customers"), F.first("elasticity").alias("elasticity"),
        F.first("discount_cost").alias("discount_cost"),
        F.min(F.when(F.col("cum_sim") - F.col("cum_base") >= F.col("discount_cost"), F.col("step")))
         .alias("break_even_day"))
    lift = F.when(F.col("_base") > 0, (F.col("_sim") - F.col("_base")) / F.col("_base") * 100).otherwise(F.lit(0.0))
    roi = F.when(F.col("discount_cost") > 0,
                 (F.col("_sim") - F.col("_base") - F.col("discount_cost")) / F.col("discount_cost") * 100)\
           .otherwise(F.lit(0.0))
    return agg.select(
        "target", F.col("discount_pct").cast("int"), F.col("horizon").cast("int"),
        js_round(F.col("_base")).alias("base_total"), js_round(F.col("_sim")).alias("sim_total"),
        js_round(lift, 1).alias("lift_pct"), F.col("discount_cost"), js_round(roi).alias("roi_pct"),
        F.col("target_customers").cast("bigint"), "elasticity",
        js_round(F.abs(F.col("elasticity")) * F.col("discount_pct") / 100.0 * 100).alias("vol_uplift_pct"),
        F.col("break_even_day").cast("int"))


def segment_impact(profiles: DataFrame, baseline: DataFrame, discounts=tuple(DISCOUNTS),
                   horizons=tuple(HORIZONS)) -> DataFrame:
    """Per scenario and segment, baseline and campaign revenue over the horizon."""
    seg = segment_elasticity(profiles)
    total = F.sum("size").over(Window.partitionBy())
    seg = seg.withColumn("seg_pct", F.when(total > 0, F.col("size") / total).otherwise(F.lit(0.0)))
    cum = baseline.select("step", F.sum("value").over(
        Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum"))
    hz = cum.filter(F.col("step").isin(*horizons)).select(F.col("step").alias("horizon"), "cum")
    targets = seg.select(F.col("label").alias("target")).unionByName(
        profiles.sparkSession.range(1).select(F.lit("all").alias("target")))
    grid = (targets.select("*", F.explode(F.array(*[F.lit(d) for d in discounts])).alias("discount_pct"))
                   .select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")))
    g = grid.join(hz, "horizon")
    # segments × scenario: the segment list (at most 8 entries) rides along as one
    # scalar-subquery array and is exploded, so no join of the two tables is needed
    segs = seg.agg(F.collect_list(F.struct("label", "seg_pct", "elasticity")).alias("segs")).scalar()
    g = g.withColumn("segs", segs)
    out = g.select("target", "discount_pct", "horizon", "cum", F.explode("segs").alias("s"))
    base = F.col("cum") * F.col("s.seg_pct")
    is_t = (F.col("target") == "all") | (F.col("target") == F.col("s.label"))
    sim = F.when(is_t, base * multiplier(F.col("s.elasticity"), F.col("discount_pct"))).otherwise(base)
    return out.select("target", F.col("discount_pct").cast("int"), F.col("horizon").cast("int"),
                      F.col("s.label").alias("segment"), js_round(base).alias("base"),
                      js_round(sim).alias("sim"), is_t.alias("targeted"))
