"""I: daily revenue forecasts for many series at once.

Every operator takes a ``series_key`` (all / category / region / product ...),
so the work is spread over series. Lines are first summed per (series, day) in
Spark; a series then holds one value per calendar day, so its size is bounded
by its date span, not by how many rows feed it, and a hot key cannot blow up
one task.

* I1–I4, I6, I7, I11–I13 are DataFrame plans (the linear tier is ``regr_slope``
  / ``regr_intercept`` per series plus a weekday-offset aggregate).
* I8–I10 are regressions. Spark builds their rows (lags and differences by windows,
  Fourier terms, scaling, the split in time), sums XᵀX and Xᵀy per series, measures the
  errors and rolls the recursions forward; only the p × p systems (p ≤ 31) are solved
  in pandas, one small row per series and model. A tier that fails for a series
  steps down the chain lag_ar → seasonal_ar → seasonal_regression, and what still
  fails goes to the linear plan. One bad series never fails the job.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..session import scratch_table

# ── Fixed values (must equal the reference's) ───────────────────────────────
DATE_CANDIDATES = ["date", "invoice_date", "order_date", "purchase_date", "created_at", "invoicedate",
                   "sale_date", "order_timestamp"]
REVENUE_CANDIDATES = ["revenue", "total_sales", "total_revenue", "amount", "total_amount", "net_sales"]
HORIZON_DAYS = 180
HORIZONS = [30, 60, 90, 180]
MIN_MONTHS, MIN_DAYS = 3, 7
LONG_TIER_DAYS, MIDDLE_TIER_DAYS, SHORT_HISTORY_DAYS = 730, 365, 60
YEARLY_MIN_SPAN_DAYS = 545
MIN_CI_WIDTH = 0.05
LOOKBACK = 30
TRAIN_SHARE = 0.85
NOT_ENOUGH = ("Not enough date-based data to generate a forecast. "
              "Upload transactional data with dates to enable this feature.")
# ─────────────────────────────────────────────────────────────────────────────

# Model names of this library's tiers (re-aimed, so not the reference's names).
TIER_ORDER = ["lag_ar", "seasonal_ar", "seasonal_regression", "linear_trend"]
Z80 = 1.2815515655446004  # two-sided 80 % normal band


def _first(df: DataFrame, names: list[str]) -> str | None:
    return next((c for c in names if c in df.columns), None)


# ── I1 ──────────────────────────────────────────────────────────────────────

def resolve_input(df: DataFrame, series_col: str | Column | None = None) -> DataFrame:
    """(series_key, ts, value) with the first date / revenue column found.

    Revenue falls back to price·quantity (missing price 0, missing quantity 1),
    then to price; unreadable amounts count as 0. Rows without a date go.
    """
    d = _first(df, DATE_CANDIDATES)
    if d is None:
        return df.sparkSession.createDataFrame([], "series_key string, ts timestamp, value double")
    r = _first(df, REVENUE_CANDIDATES)
    cols = set(df.columns)
    if r is not None:
        val = N.numeric_or_number(r, dict(df.dtypes)[r])
    elif "price" in cols and "quantity" in cols:
        val = (F.coalesce(N.numeric_or_number("price", dict(df.dtypes)["price"]), F.lit(0.0))
               * F.coalesce(N.numeric_or_number("quantity", dict(df.dtypes)["quantity"]), F.lit(1.0)))
    elif "price" in cols:
        val = N.numeric_or_number("price", dict(df.dtypes)["price"])
    else:
        return df.sparkSession.createDataFrame([], "series_key string, ts timestamp, value double")
    if series_col is None:
        key = F.lit("all")
    else:
        key = (F.col(series_col) if isinstance(series_col, str) else series_col).cast("string")
    ts = F.col(d).cast("timestamp") if dict(df.dtypes)[d].startswith(("timestamp", "date")) \
        else F.col(d).cast("string").try_cast("timestamp")
    out = df.select(key.alias("series_key"), ts.alias("ts"), F.coalesce(val, F.lit(0.0)).alias("value"))
    return out.filter(F.col("ts").isNotNull())


# ── I2 / I3 / I4 ─────────────────────────────────────────────────────────────

def monthly_history(inp: DataFrame) -> DataFrame:
    """Revenue per (series, month) over rows with value > 0."""
    return (inp.filter(F.col("value") > 0)
               .groupBy("series_key", N.month_str("ts").alias("month"))
               .agg(F.sum("value").alias("revenue")))


def daily_series(inp: DataFrame) -> DataFrame:
    """Calendar-complete daily totals per series (missing days 0, negatives kept).

    Output: series_key, day (date), t (0-based day index), revenue.
    Gaps are filled without a calendar join: each day with sales explodes into
    itself plus the empty days up to the series' next day with sales (``lead``
    over the series, whose size is its number of days).
    """
    sums = inp.groupBy("series_key", F.to_date("ts").alias("day")).agg(F.sum("value").alias("revenue"))
    by_day = Window.partitionBy("series_key").orderBy("day")
    whole = Window.partitionBy("series_key")
    g = sums.select("series_key", "day", "revenue",
                    F.min("day").over(whole).alias("d0"),
                    F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), F.col("day")).alias("until"))
    filled = g.select("series_key", "d0", "day", "revenue",
                      F.explode(F.sequence("day", "until", F.expr("INTERVAL 1 DAY"))).alias("d"))
    return filled.select("series_key", F.col("d").alias("day"), F.datediff("d", "d0").alias("t"),
                         F.when(F.col("d") == F.col("day"), F.col("revenue")).otherwise(F.lit(0.0))
                          .alias("revenue"))


def select_tier(n_days: Column) -> Column:
    """I4: model tier from the number of days."""
    return (F.when(n_days > LONG_TIER_DAYS, "lag_ar")
             .when(n_days >= MIDDLE_TIER_DAYS, "seasonal_ar")
             .otherwise("seasonal_regression"))


def series_profile(inp: DataFrame) -> DataFrame:
    """I2–I4 per series: months, days, eligibility, tier and short-history flag (one aggregate)."""
    day = F.to_date("ts")
    p = inp.groupBy("series_key").agg(
        F.count_distinct(F.when(F.col("value") > 0, N.month_str("ts"))).alias("n_months"),
        (F.datediff(F.max(day), F.min(day)) + 1).alias("n_days"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    eligible = (F.col("n_months") >= MIN_MONTHS) & (F.col("n_days") >= MIN_DAYS)
    return p.select("series_key", F.col("n_months").cast("bigint"), F.col("n_days").cast("bigint"),
                    N.day_str("first_day").alias("first_day"), N.day_str("last_day").alias("last_day"),
                    eligible.alias("eligible"),
                    F.when(eligible, select_tier(F.col("n_days"))).alias("tier"),
                    (eligible & (F.col("n_days") < SHORT_HISTORY_DAYS)).alias("short_history"))


# ── I6 / I7 / I13: linear tier in Spark ─────────────────────────────────────

def _linear_parts(daily: DataFrame) -> DataFrame:
    """One pass over the daily table: per (series, weekday) residual mean and
    absolute-residual sums, carrying the series' line (window aggregates over a
    series, whose size is its number of days)."""
    w = Window.partitionBy("series_key")
    d = daily.select(
        "series_key", "day", "t", "revenue",
        F.coalesce(F.regr_slope("revenue", "t").over(w), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("revenue", "t").over(w), F.lit(0.0)).alias("intercept"),
        F.count(F.lit(1)).over(w).alias("n"), F.max("day").over(w).alias("last_day"),
        F.avg(F.abs("revenue")).over(w).alias("mean_abs"))
    d = d.withColumn("resid", F.col("revenue") - (F.col("slope") * F.col("t") + F.col("intercept")))
    return d.groupBy("series_key", F.weekday("day").alias("dow")).agg(
        F.avg("resid").alias("offset"), F.sum(F.abs("resid")).alias("_abs"), F.count(F.lit(1)).alias("_c"),
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("n").alias("n"),
        F.first("last_day").alias("last_day"), F.first("mean_abs").alias("mean_abs"))


def _fit_from_parts(parts: DataFrame) -> DataFrame:
    fit = parts.groupBy("series_key").agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("n").alias("n"),
        F.first("last_day").alias("last_day"), F.first("mean_abs").alias("mean_abs"),
        (F.sum("_abs") / F.sum("_c")).alias("mae"))
    width = F.greatest(F.lit(MIN_CI_WIDTH), F.col("mae") / (F.col("mean_abs") + F.lit(1e-9)))
    return fit.withColumn("width", width)


def linear_fit(daily: DataFrame) -> DataFrame:
    """Per series: slope, intercept, n, last day, MAE of the line, mean |y|, width."""
    return _fit_from_parts(_linear_parts(daily))


def weekday_offsets(daily: DataFrame) -> DataFrame:
    """Mean residual of the line per weekday (Mon=0)."""
    return _linear_parts(daily).select("series_key", "dow", "offset")


def linear_forecast(daily: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """I6 + I7: line + weekday offsets, clipped at 0, multiplicative band.

    Output: series_key, model_used, step, date, predicted, lower, upper, mae.
    The daily table is read once: one per-(series, weekday) aggregate, then one
    per-series row carrying the line, the MAE and the weekday offsets as a map,
    exploded into the future days.
    """
    parts = _linear_parts(daily)
    fit = parts.groupBy("series_key").agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("n").alias("n"),
        F.first("last_day").alias("last_day"), F.first("mean_abs").alias("mean_abs"),
        (F.sum("_abs") / F.sum("_c")).alias("mae"),
        F.map_from_entries(F.collect_list(F.struct("dow", "offset"))).alias("offsets"))
    width = F.greatest(F.lit(MIN_CI_WIDTH), F.col("mae") / (F.col("mean_abs") + F.lit(1e-9)))
    fut = fit.select("*", width.alias("width"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    fut = fut.withColumn("day", F.date_add("last_day", F.col("step")))
    off = F.coalesce(F.element_at("offsets", F.weekday("day")), F.lit(0.0))
    x = F.col("n") - 1 + F.col("step")
    val = F.greatest(F.col("slope") * x + F.col("intercept") + off, F.lit(0.0))
    return fut.select("series_key", F.lit("linear_trend").alias("model_used"), "step",
                      N.day_str("day").alias("date"), F.round(val, 2).alias("predicted"),
                      F.round(val * (1 - F.col("width")), 2).alias("lower"),
                      F.round(val * (1 + F.col("width")), 2).alias("upper"),
                      F.round("mae", 2).alias("mae"))


def backtest_linear(daily: DataFrame) -> DataFrame:
    """I13 for the linear tier: in-sample absolute error per series."""
    fit = linear_fit(daily)
    return fit.select("series_key", F.lit("linear_trend").alias("model_used"),
                      F.col("n").cast("bigint").alias("n_points"), F.round("mae", 2).alias("mae"))


# ── I8–I10, I13: regression tiers; Spark builds rows and sums, pandas solves p × p ──

WEEKLY_ORDER, YEARLY_ORDER = 3, 10
AR_LAGS = (1, 2, 7)
AR_MIN_DAYS = 40
_MAX_TERMS = 2 + 2 * (WEEKLY_ORDER + YEARLY_ORDER) + 3  # 31: the longest row, that of the lag regression


def _fourier(d: Column) -> tuple[list[Column], list[Column]]:
    def terms(period: float, order: int) -> list[Column]:
        return [f(F.lit(2 * math.pi * k / period) * d) for k in range(1, order + 1) for f in (F.sin, F.cos)]
    return terms(7.0, WEEKLY_ORDER), terms(365.25, YEARLY_ORDER)


def _regression_row(t: Column, d: Column, yearly: Column) -> Column:
    """I8 terms of a day: trend, weekly and, for a long span, yearly Fourier terms."""
    week, year = _fourier(d)
    base = [F.lit(1.0), t / F.lit(365.25), *week]
    return F.when(yearly, F.array(*base, *year)).otherwise(F.array(*base))


def _epoch_day(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("double")


def _lagged(daily: DataFrame, profile: DataFrame) -> DataFrame:
    """Each day of the eligible series with the 30 days before, differences, scaling and the series' size."""
    elig = profile.filter("eligible").select("series_key", "tier")
    order = Window.partitionBy("series_key").orderBy("t")
    whole = Window.partitionBy("series_key")
    d = daily.join(elig, "series_key").select(
        "series_key", "tier", "day", "t", "revenue",
        F.collect_list("revenue").over(order.rowsBetween(-LOOKBACK, -1)).alias("back"),
        F.count(F.lit(1)).over(whole).alias("n"), F.min("revenue").over(whole).alias("lo"),
        F.max("revenue").over(whole).alias("hi"), F.avg(F.abs("revenue")).over(whole).alias("mean_abs"))
    # the (1, 7)-difference of I9
    z = F.when(F.col("t") >= 8, F.col("revenue") - F.element_at("back", -1) - F.element_at("back", -7) + F.element_at("back", -8))
    return (d.withColumn("z", z).withColumn("scale", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)))
            .withColumn("zback", F.collect_list("z").over(order.rowsBetween(-max(AR_LAGS), -1))))


def design_rows(daily: DataFrame, profile: DataFrame) -> DataFrame:
    """(series_key, model, t, x, y, train): regression rows of every model that a series' chain may reach.

    ``seasonal_regression`` (I8) explains revenue by calendar terms; ``seasonal_ar`` (I9) the
    (1, 7)-difference by its lags 1, 2 and 7; ``lag_ar`` (I10) the min-max scaled revenue by the 30
    days before, the first 85 % of the days being the training part.
    """
    return _design(_lagged(daily, profile))


def _design(d: DataFrame) -> DataFrame:
    n, t, tier = F.col("n"), F.col("t"), F.col("tier")
    yearly = n - 1 >= YEARLY_MIN_SPAN_DAYS
    n_terms = F.when(yearly, 2 + 2 * (WEEKLY_ORDER + YEARLY_ORDER)).otherwise(2 + 2 * WEEKLY_ORDER)

    def row(model: str, x: Column, y: Column, train: Column) -> Column:
        return F.struct(F.lit(model).alias("model"), x.alias("x"), y.cast("double").alias("y"), train.alias("train"))

    z = [F.element_at("zback", -lag) for lag in AR_LAGS]
    split = F.greatest(F.lit(1), F.floor((n - LOOKBACK) * TRAIN_SHARE))
    scaled = F.transform("back", lambda v: (v - F.col("lo")) / F.col("scale"))
    rows = F.array(
        F.when(n >= n_terms + 2, row("seasonal_regression", _regression_row(t, _epoch_day(F.col("day")), yearly),
                                     F.col("revenue"), F.lit(True))),
        F.when((tier != "seasonal_regression") & (n >= AR_MIN_DAYS) & (t >= 8 + max(AR_LAGS)),
               row("seasonal_ar", F.array(*z), F.col("z"), F.lit(True))),
        F.when((tier == "lag_ar") & (n >= LOOKBACK + 2) & (t >= LOOKBACK),
               row("lag_ar", F.concat(F.array(F.lit(1.0)), scaled), (F.col("revenue") - F.col("lo")) / F.col("scale"),
                   t - LOOKBACK < split)))
    return d.select("series_key", "t", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(
        "series_key", "r.model", "t", "r.x", "r.y", "r.train")


def gram_rows(design: DataFrame) -> DataFrame:
    """(series_key, model, i, g, xy, yy, m): row i of XᵀX, of Xᵀy, and Σy² and the number of training days."""
    each = design.filter("train").select("series_key", "model", "x", "y", F.posexplode("x").alias("i", "xi"))
    g = F.array(*[F.sum(F.col("xi") * F.get("x", F.lit(j))) for j in range(_MAX_TERMS)])
    return each.groupBy("series_key", "model", "i").agg(
        g.alias("g"), F.sum(F.col("xi") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.count(F.lit(1)).alias("m"))


def _solve(g: np.ndarray, xy: np.ndarray, ridge: float) -> np.ndarray:
    g = g + np.eye(len(g)) * ridge * (np.trace(g) / max(len(g), 1) + 1.0)
    return np.linalg.solve(g, xy)


def _coefficients(model: str, g: np.ndarray, xy: np.ndarray, yy: float, m: int) -> tuple[np.ndarray, int]:
    """(coefficients, how many are free); I9 chooses its order by AIC, the lags left out being zero."""
    if model != "seasonal_ar":
        return _solve(g, xy, 1e-4 if model == "lag_ar" else 1e-8), len(xy)
    best = None
    for use in ([2], [0, 2], [0, 1, 2]):
        b = _solve(g[np.ix_(use, use)], xy[use], 1e-8)
        rss = yy - 2 * b @ xy[use] + b @ g[np.ix_(use, use)] @ b
        aic = m * math.log(max(rss, 1e-300) / m) + 2 * (len(use) + 1)
        if best is None or aic < best[0]:
            full = np.zeros(len(xy))
            full[use] = b
            best = (aic, full, len(use))
    return best[1], best[2]


_SOLVED = "series_key string, model string, beta array<double>, free int, error string"


def solve_series(gram: DataFrame) -> DataFrame:
    """One row per (series, model): its coefficients, or why there are none."""
    systems = gram.groupBy("series_key", "model").agg(
        F.sort_array(F.collect_list(F.struct("i", "g", "xy"))).alias("rows"), F.first("yy").alias("yy"), F.first("m").alias("m"))

    def run(batches):
        for pdf in batches:
            out = []
            for key, model, rows, yy, m in pdf.itertuples(index=False):
                p = len(rows)
                g = np.array([[v for v in r["g"][:p]] for r in rows], dtype=float)
                try:
                    beta, free = _coefficients(model, g, np.array([r["xy"] for r in rows], dtype=float), yy, int(m))
                    if not np.all(np.isfinite(beta)):
                        raise ValueError("non-finite coefficients")
                    out.append((key, model, beta.tolist(), free, None))
                except (np.linalg.LinAlgError, ValueError) as exc:  # the series steps down its chain
                    out.append((key, model, None, 0, str(exc)))
            yield pd.DataFrame(out, columns=["series_key", "model", "beta", "free", "error"])

    return systems.mapInPandas(run, _SOLVED)


def _dot(x: str, beta: str) -> Column:
    return F.expr(f"aggregate(zip_with({x}, {beta}, (a, b) -> a * b), 0D, (s, v) -> s + v)")


def series_fits(daily: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per (series, model): coefficients, errors, and what a forecast starts from.

    ``mae`` is in revenue: over the training days for I8 and I9 (a step ahead), over the held-out days for I10.
    """
    d = scratch_table(_lagged(daily, profile), "forecast-days")
    design = _design(d)
    solved = solve_series(gram_rows(design))
    error = (F.col("y") - _dot("x", "beta"))
    judged = ~F.col("train") | (F.col("model") != "lag_ar")
    scored = design.join(solved, ["series_key", "model"]).withColumn("e", error).groupBy("series_key", "model").agg(
        F.first("beta").alias("beta"), F.first("free").alias("free"), F.first("error").alias("error"),
        F.coalesce(F.avg(F.when(judged, F.abs("e"))), F.avg(F.abs("e"))).alias("mae"), F.sum(F.col("e") * F.col("e")).alias("sse"),
        F.count(F.lit(1)).alias("m"))
    last = d.filter("t = n - 1").select(
        "series_key", "tier", "n", F.col("day").alias("last_day"), "lo", "scale", "mean_abs",
        F.concat("back", F.array("revenue")).alias("tail"), F.concat("zback", F.array("z")).alias("ztail"))
    fits = scored.join(last, "series_key")
    mae = F.when(F.col("model") == "lag_ar", F.col("mae") * F.col("scale")).otherwise(F.col("mae"))
    return fits.withColumn("mae", mae).withColumn("sigma", F.sqrt(F.col("sse") / F.greatest(F.col("m") - F.col("free"), F.lit(1))))


def backtest_models(daily: DataFrame, profile: DataFrame) -> DataFrame:
    """I13 for every tier: absolute error per series and model, the linear line included."""
    fits = series_fits(daily, profile).filter("beta IS NOT NULL").select(
        "series_key", F.col("model").alias("model_used"), F.col("n").cast("bigint").alias("n_points"), F.round("mae", 2).alias("mae"))
    elig = profile.filter("eligible").select("series_key")
    return fits.unionByName(backtest_linear(daily.join(elig, "series_key", "left_semi")))


def _roll_ar(horizon: int) -> Column:
    """I9 rolled forward: each day's difference from the lagged ones, then the level."""
    step = """struct(concat(s.y, array(element_at(s.y, -1) + element_at(s.y, -7) - element_at(s.y, -8)
                  + beta[0] * element_at(s.z, -1) + beta[1] * element_at(s.z, -2) + beta[2] * element_at(s.z, -7))) AS y,
              concat(s.z, array(beta[0] * element_at(s.z, -1) + beta[1] * element_at(s.z, -2) + beta[2] * element_at(s.z, -7))) AS z)"""
    return F.expr(f"slice(aggregate(sequence(1, {horizon}), struct(tail AS y, ztail AS z), (s, k) -> {step}).y, -{horizon}, {horizon})")


def _roll_lags(horizon: int) -> Column:
    """I10 rolled forward over the scaled series, scaled back."""
    scaled = "transform(tail, v -> (v - lo) / scale)"
    nxt = (f"beta[0] + aggregate(zip_with(slice(s, -{LOOKBACK}, {LOOKBACK}), slice(beta, 2, {LOOKBACK}), (a, b) -> a * b), 0D, "
           "(q, v) -> q + v)")
    rolled = f"aggregate(sequence(1, {horizon}), {scaled}, (s, k) -> concat(s, array({nxt})))"
    return F.expr(f"transform(slice({rolled}, -{horizon}, {horizon}), v -> v * scale + lo)")


def _forecast_points(fits: DataFrame, horizon: int) -> DataFrame:
    """(series_key, model, step, date, predicted, lower, upper, mae), not rounded, of each fit."""
    steps = F.sequence(F.lit(1), F.lit(horizon))
    reg = (fits.filter("model = 'seasonal_regression'").select("*", F.explode(steps).alias("step"))
           .withColumn("x", _regression_row(F.col("n") - 1 + F.col("step"), _epoch_day(F.col("last_day")) + F.col("step"),
                                            F.col("n") - 1 >= YEARLY_MIN_SPAN_DAYS))
           .withColumn("p", _dot("x", "beta")).withColumn("half", F.lit(Z80) * F.col("sigma")).drop("x"))
    ar = (fits.filter("model = 'seasonal_ar'").select("*", F.posexplode(_roll_ar(horizon)).alias("k", "p"))
          .withColumn("step", F.col("k") + 1).withColumn("half", F.lit(Z80) * F.col("sigma") * F.sqrt("step")).drop("k"))
    lag = (fits.filter("model = 'lag_ar'").select("*", F.posexplode(_roll_lags(horizon)).alias("k", "p"))
           .withColumn("step", F.col("k") + 1)
           .withColumn("half", F.greatest(F.lit(MIN_CI_WIDTH), F.col("mae") / (F.col("mean_abs") + F.lit(1e-9))) * F.greatest("p", F.lit(0.0)))
           .drop("k"))
    every = reg.unionByName(ar).unionByName(lag)
    zero = F.lit(0.0)
    # the band of I8 and I9 is around the line before it is cut at 0, that of I10 around the cut value
    middle = F.when(F.col("model") == "lag_ar", F.greatest("p", zero)).otherwise(F.col("p"))
    return every.select("series_key", "model", "step", N.day_str(F.date_add("last_day", F.col("step"))).alias("date"),
                        F.greatest("p", zero).alias("predicted"), F.greatest(middle - F.col("half"), zero).alias("lower"),
                        F.greatest(middle + F.col("half"), zero).alias("upper"), "mae")


def model_forecast(daily: DataFrame, profile: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """I5 + I8–I10: each eligible series by the first model of its chain that can be fitted; linear as last step."""
    fits = scratch_table(series_fits(daily, profile), "forecast-fits")
    points = scratch_table(_forecast_points(fits.filter("beta IS NOT NULL"), horizon), "forecast-points")
    finite = points.groupBy("series_key", "model").agg(
        F.bool_and(F.col("predicted").between(-1e300, 1e300) & F.col("mae").between(0, 1e300)).alias("finite"))
    rank = F.array_position(F.array(*[F.lit(m) for m in TIER_ORDER]), F.col("model"))
    elig = profile.filter("eligible").select("series_key", "tier")
    chain = elig.select("series_key", "tier", F.explode(F.slice(
        F.array(*[F.lit(m) for m in TIER_ORDER[:-1]]),
        F.array_position(F.array(*[F.lit(m) for m in TIER_ORDER]), F.col("tier")).cast("int"), F.lit(len(TIER_ORDER)))).alias("model"))
    tried = (chain.join(fits.select("series_key", "model", "error"), ["series_key", "model"], "left")
             .join(finite, ["series_key", "model"], "left").withColumn("rank", rank)
             .withColumn("why", F.when(F.col("finite"), None).otherwise(F.coalesce(
                 "error", F.when(F.col("finite").isNull(), F.lit("too few days")).otherwise(F.lit("non-finite forecast"))))))
    chosen = tried.groupBy("series_key", "tier").agg(
        F.min(F.when(F.col("finite"), F.col("rank"))).alias("at"),
        F.sort_array(F.collect_list(F.struct("rank", "model", "why"))).alias("tried"))
    used = F.coalesce(F.element_at(F.array(*[F.lit(m) for m in TIER_ORDER]), F.col("at").cast("int")), F.lit(TIER_ORDER[-1]))
    failed = F.expr("filter(tried, x -> x.why IS NOT NULL AND (at IS NULL OR x.rank < at))")
    chosen = scratch_table(chosen.select("series_key", "tier", used.alias("model"), F.when(used != F.col("tier"), F.format_string(
        "This length of history calls for %s, which fell back to %s (%s).", F.col("tier"), used,
        F.element_at(failed, -1)["why"])).alias("note")), "forecast-chosen")
    ok = points.join(chosen.select("series_key", "model", "note"), ["series_key", "model"]).select(
        "series_key", F.col("model").alias("model_used"), "step", "date",
        *[(F.round(c, 2) + 0.0).alias(c) for c in ("predicted", "lower", "upper", "mae")], "note")
    rest = chosen.filter(F.col("model") == TIER_ORDER[-1]).select("series_key", "note")
    lin = linear_forecast(daily.join(rest, "series_key", "left_semi"), horizon).join(rest, "series_key")
    out = ok.unionByName(lin.withColumn("step", F.col("step").cast("int")).select(*ok.columns))
    warn = profile.select("series_key", F.when(F.col("short_history"), F.format_string(
        "There are no more than %d days of history: the band is rough, and near days are safer than far ones.",
        F.col("n_days"))).alias("_short"))
    return out.join(warn, "series_key", "left").withColumn(
        "warning", F.coalesce("note", "_short")).drop("note", "_short")


def forecast(inp: DataFrame, horizon: int = HORIZON_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole forecast for every series: (per-series status, forecast points, monthly history).

    Status row per series: model_used ('none' when not eligible), tier, days,
    months, has_date_data, warning, mae.
    """
    # one row per series and per series-day, bounded by the calendar; each is read several times below
    prof = scratch_table(series_profile(inp), "forecast-profile")
    daily = scratch_table(daily_series(inp), "forecast-daily")
    fc = model_forecast(daily, prof, horizon)
    status_fc = fc.groupBy("series_key").agg(F.first("model_used").alias("model_used"),
                                             F.first("mae").alias("mae"), F.first("warning").alias("warning"))
    status = prof.join(status_fc, "series_key", "left").select(
        "series_key", "tier", "n_days", "n_months",
        F.when(F.col("eligible"), F.col("model_used")).otherwise(F.lit("none")).alias("model_used"),
        F.col("eligible").alias("has_date_data"),
        F.when(F.col("eligible"), F.col("warning")).otherwise(F.lit(NOT_ENOUGH)).alias("warning"),
        F.coalesce("mae", F.lit(0.0)).alias("mae"))
    hist = (monthly_history(inp).join(prof.select("series_key", "eligible"), "series_key")
            .filter("eligible").select("series_key", F.col("month").alias("date"),
                                       F.round("revenue", 2).alias("revenue")))
    return status, fc, hist


# ── I11 / I12 ────────────────────────────────────────────────────────────────

def horizon_kpis(fc: DataFrame, history: DataFrame, horizons=tuple(HORIZONS)) -> DataFrame:
    """Per series and horizon: total, first, last, growth %, last actual month."""
    hs = F.array(*[F.lit(h) for h in horizons])
    cut = fc.select("*", F.explode(hs).alias("horizon")).filter(F.col("step") <= F.col("horizon"))
    k = cut.groupBy("series_key", "horizon").agg(
        F.round(F.sum("predicted"), 2).alias("total_forecast"),
        F.min_by("predicted", "step").alias("forecast_start"),
        F.max_by("predicted", "step").alias("forecast_end"))
    last = history.groupBy("series_key").agg(F.max_by("revenue", "date").alias("last_actual"))
    growth = F.when(F.col("forecast_start") > 0, F.round((F.col("forecast_end") - F.col("forecast_start"))
                                                         / F.col("forecast_start") * 100, 1)).otherwise(F.lit(0.0))
    return k.join(last, "series_key", "left").select(
        "series_key", F.col("horizon").cast("int"), "total_forecast", "forecast_start", "forecast_end",
        growth.alias("growth_pct"), F.coalesce("last_actual", F.lit(0.0)).alias("last_actual"))


def downsample(fc: DataFrame, horizon: int = HORIZON_DAYS, target_points: int = 30) -> DataFrame:
    """Every step-th point of the first ``horizon`` days, plus the last one."""
    cut = fc.filter(F.col("step") <= horizon)
    n = F.count(F.lit(1)).over(Window.partitionBy("series_key"))
    step = F.greatest(F.lit(1), F.floor(n / target_points))
    i = F.col("step") - 1
    return cut.withColumn("_keep", (i % step == 0) | (i == n - 1)).filter("_keep").drop("_keep")
