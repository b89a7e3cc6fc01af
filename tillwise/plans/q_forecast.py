"""Registered queries for section I (forecast) on the test data.

Series: one per product category over the whole span (long tier), plus three
date windows of all sales chosen to land in each tier ('full' 2 405 days,
'mid' 547 days, 'short' 50 days with the short-history warning), and the
``events`` table (one month: not enough data).
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import forecast as I
from ..operators import forecast_rich as R
from . import prepare
from .registry import register
from .sql import with_events, with_sales

WINDOWS = [("full", None, None), ("mid", "1995-01-01", "1996-06-30"), ("short", "1995-01-15", "1995-03-05")]


def window_input(sales):
    parts = []
    for name, lo, hi in WINDOWS:
        s = sales
        if lo is not None:
            s = s.filter((F.to_date("date") >= F.lit(lo).cast("date")) & (F.to_date("date") <= F.lit(hi).cast("date")))
        parts.append(I.resolve_input(s, F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _window_sql() -> str:
    parts = []
    for name, lo, hi in WINDOWS:
        cond = "" if lo is None else f" WHERE CAST(date AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}'"
        parts.append(f"SELECT '{name}' AS series_key, date AS ts, revenue AS value FROM sales{cond}")
    return "\nUNION ALL\n".join(parts)


def _cat_input(spark, sf_dir):
    return I.resolve_input(prepare.clean_sales(spark, sf_dir, columns=("category",)), "category")


DAILY_SQL = """
, sums AS (SELECT series_key, CAST(ts AS DATE) AS day, sum(value) AS revenue FROM inp GROUP BY 1, 2),
b AS (SELECT series_key, min(day) AS d0, max(day) AS d1 FROM sums GROUP BY 1),
spine AS (SELECT series_key, d0, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
daily AS (SELECT s.series_key, s.day, CAST(s.day - s.d0 AS BIGINT) AS t, coalesce(x.revenue, 0.0) AS revenue
          FROM spine s LEFT JOIN sums x ON x.series_key = s.series_key AND x.day = s.day)
"""

LINEAR_SQL = DAILY_SQL + """
, fit AS (SELECT series_key, coalesce(regr_slope(revenue, t), 0.0) AS slope,
                 coalesce(regr_intercept(revenue, t), 0.0) AS intercept, count(*) AS n,
                 max(day) AS last_day, avg(abs(revenue)) AS mean_abs FROM daily GROUP BY 1),
res AS (SELECT d.*, d.revenue - (f.slope * d.t + f.intercept) AS resid
        FROM daily d JOIN fit f USING (series_key)),
mae AS (SELECT series_key, avg(abs(resid)) AS mae FROM res GROUP BY 1),
offs AS (SELECT series_key, isodow(day) - 1 AS dow, avg(resid) AS off FROM res GROUP BY 1, 2),
f2 AS (SELECT fit.*, mae.mae, greatest(0.05, mae.mae / (fit.mean_abs + 1e-9)) AS width
       FROM fit JOIN mae USING (series_key)),
fut AS (SELECT f2.*, unnest(generate_series(1, 180)) AS step FROM f2),
fut2 AS (SELECT fut.*, CAST(last_day + CAST(step AS INTEGER) AS DATE) AS fday FROM fut),
fc AS (SELECT fut2.series_key, 'linear_trend' AS model_used, CAST(step AS BIGINT) AS step,
              strftime(fday, '%Y-%m-%d') AS date,
              greatest(slope * (n - 1 + step) + intercept + coalesce(o.off, 0.0), 0.0) AS val,
              width, mae
       FROM fut2 LEFT JOIN offs o ON o.series_key = fut2.series_key AND o.dow = isodow(fut2.fday) - 1),
lin AS (SELECT series_key, model_used, step, date, round(val, 2) + 0.0 AS predicted,
               round(val * (1 - width), 2) + 0.0 AS lower, round(val * (1 + width), 2) + 0.0 AS upper,
               round(mae, 2) AS mae FROM fc)
"""

CAT_INP = ", inp AS (SELECT category AS series_key, date AS ts, revenue AS value FROM sales)"


@register("forecast_monthly_history", with_sales(f", inp AS ({_window_sql()})" + """
, m AS (SELECT series_key, strftime(ts, '%Y-%m') AS month, sum(value) AS revenue FROM inp
        WHERE value > 0 GROUP BY 1, 2)
SELECT series_key, month AS date, round(revenue, 2) AS revenue FROM m
WHERE series_key IN (SELECT series_key FROM m GROUP BY 1 HAVING count(*) >= 3)
"""))
def forecast_monthly_history(spark, sf_dir):
    """I1 + I2: monthly history of the series with at least 3 months."""
    inp = window_input(prepare.clean_sales(spark, sf_dir, columns=()))
    m = I.monthly_history(inp)
    months = F.count(F.lit(1)).over(Window.partitionBy("series_key"))  # one row per month of a series
    return m.withColumn("_months", months).filter(F.col("_months") >= I.MIN_MONTHS) \
            .select("series_key", F.col("month").alias("date"), F.round("revenue", 2).alias("revenue"))


@register("forecast_daily_series", with_sales(CAT_INP + DAILY_SQL + """
SELECT series_key, strftime(day, '%Y-%m-%d') AS day, t, round(revenue, 2) AS revenue FROM daily
"""))
def forecast_daily_series(spark, sf_dir):
    """Calendar-complete daily revenue per category."""
    d = I.daily_series(_cat_input(spark, sf_dir))
    return d.select("series_key", F.date_format("day", "yyyy-MM-dd").alias("day"), "t",
                    F.round("revenue", 2).alias("revenue"))


@register("forecast_tiers", with_sales(f", inp AS ({_window_sql()})" + """
, m AS (SELECT series_key, count(*) AS n_months FROM
          (SELECT DISTINCT series_key, strftime(ts, '%Y-%m') AS mo FROM inp WHERE value > 0) GROUP BY 1),
d AS (SELECT series_key, CAST(max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS BIGINT) AS n_days,
             strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
      FROM inp GROUP BY 1),
p AS (SELECT d.*, CAST(coalesce(m.n_months, 0) AS BIGINT) AS n_months,
             coalesce(m.n_months, 0) >= 3 AND n_days >= 7 AS eligible FROM d LEFT JOIN m USING (series_key))
SELECT series_key, n_months, n_days, first_day, last_day, eligible,
       CASE WHEN eligible THEN CASE WHEN n_days > 730 THEN 'lag_ar' WHEN n_days >= 365 THEN 'seasonal_ar'
                                    ELSE 'seasonal_regression' END END AS tier,
       eligible AND n_days < 60 AS short_history
FROM p
"""))
def forecast_tiers(spark, sf_dir):
    """I4: tier and short-history flag per series."""
    return I.series_profile(window_input(prepare.clean_sales(spark, sf_dir, columns=())))


@register("forecast_tiers_events", with_events("""
, inp AS (SELECT 'all' AS series_key, date AS ts, revenue AS value FROM ev),
m AS (SELECT series_key, count(*) AS n_months FROM
        (SELECT DISTINCT series_key, strftime(ts, '%Y-%m') AS mo FROM inp WHERE value > 0) GROUP BY 1),
d AS (SELECT series_key, CAST(max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS BIGINT) AS n_days,
             strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
      FROM inp GROUP BY 1),
p AS (SELECT d.*, CAST(coalesce(m.n_months, 0) AS BIGINT) AS n_months,
             coalesce(m.n_months, 0) >= 3 AND n_days >= 7 AS eligible FROM d LEFT JOIN m USING (series_key))
SELECT series_key, n_months, n_days, first_day, last_day, eligible,
       CASE WHEN eligible THEN 'x' END AS tier, eligible AND n_days < 60 AS short_history
FROM p
"""))
def forecast_tiers_events(spark, sf_dir):
    """I2–I4 on events: one month of data, so not eligible."""
    return I.series_profile(I.resolve_input(prepare.events_sales(spark, sf_dir)))


@register("forecast_linear", with_sales(CAT_INP + LINEAR_SQL + "SELECT * FROM lin"))
def forecast_linear(spark, sf_dir):
    """I6 + I7: linear trend + weekday offsets per category, 180 days, band."""
    return I.linear_forecast(I.daily_series(_cat_input(spark, sf_dir)))


@register("forecast_backtest_linear", with_sales(CAT_INP + LINEAR_SQL + """
SELECT series_key, 'linear_trend' AS model_used, CAST(n AS BIGINT) AS n_points, round(mae, 2) AS mae FROM f2
"""))
def forecast_backtest_linear(spark, sf_dir):
    """In-sample absolute error of the linear tier per series."""
    return I.backtest_linear(I.daily_series(_cat_input(spark, sf_dir)))


@register("forecast_horizon_kpis", with_sales(CAT_INP + LINEAR_SQL + """
, m AS (SELECT series_key, strftime(ts, '%Y-%m') AS month, round(sum(value), 2) AS revenue FROM inp
        WHERE value > 0 GROUP BY 1, 2),
la AS (SELECT series_key, arg_max(revenue, month) AS last_actual FROM m GROUP BY 1),
h AS (SELECT unnest([30, 60, 90, 180]) AS horizon),
k AS (SELECT lin.series_key, h.horizon, round(sum(predicted), 2) AS total_forecast,
             arg_min(predicted, step) AS forecast_start, arg_max(predicted, step) AS forecast_end
      FROM lin, h WHERE lin.step <= h.horizon GROUP BY 1, 2)
SELECT k.series_key, CAST(horizon AS BIGINT) AS horizon, total_forecast, forecast_start, forecast_end,
       CASE WHEN forecast_start > 0 THEN round((forecast_end - forecast_start) / forecast_start * 100, 1) + 0.0
            ELSE 0.0 END AS growth_pct,
       coalesce(la.last_actual, 0.0) AS last_actual
FROM k LEFT JOIN la USING (series_key)
"""))
def forecast_horizon_kpis(spark, sf_dir):
    """I11 on the linear forecast."""
    inp = _cat_input(spark, sf_dir)
    fc = I.linear_forecast(I.daily_series(inp))
    hist = I.monthly_history(inp).select("series_key", F.col("month").alias("date"),
                                         F.round("revenue", 2).alias("revenue"))
    return I.horizon_kpis(fc, hist)


@register("forecast_downsample", with_sales(CAT_INP + LINEAR_SQL + """
, c AS (SELECT lin.*, count(*) OVER (PARTITION BY series_key) AS n FROM lin WHERE step <= 90)
SELECT series_key, model_used, step, date, predicted, lower, upper, mae FROM c
WHERE (step - 1) % greatest(1, floor(n / 30)) = 0 OR step - 1 = n - 1
"""))
def forecast_downsample(spark, sf_dir):
    """The 90-day cut down-sampled to about 30 points plus the last."""
    return I.downsample(I.linear_forecast(I.daily_series(_cat_input(spark, sf_dir))), 90, 30)


@register("forecast_models")
def forecast_models(spark, sf_dir):
    """I5 + I8–I10: tiered model forecast for the three windows (lag_ar / seasonal_ar / seasonal_regression)."""
    status, fc, _ = I.forecast(window_input(prepare.clean_sales(spark, sf_dir, columns=())))
    return fc.join(status.select("series_key", "tier"), "series_key")


_ANGLES = [(2 * math.pi * k / period, f) for period, order in ((7.0, I.WEEKLY_ORDER), (365.25, I.YEARLY_ORDER))
           for k in range(1, order + 1) for f in ("sin", "cos")]
_WEEK = ", ".join(f"{f}({w!r}::DOUBLE * d)" for w, f in _ANGLES[:2 * I.WEEKLY_ORDER])
_YEAR = ", ".join(f"{f}({w!r}::DOUBLE * d)" for w, f in _ANGLES[2 * I.WEEKLY_ORDER:])


@register("forecast_gram", with_sales(f", inp AS ({_window_sql()})" + DAILY_SQL + f"""
, dd AS (SELECT series_key, t, revenue AS y, (day - DATE '1970-01-01')::DOUBLE AS d, count(*) OVER (PARTITION BY series_key) AS n FROM daily),
xx AS (SELECT series_key, t, y, CASE WHEN n - 1 >= {I.YEARLY_MIN_SPAN_DAYS} THEN [1, t / 365.25::DOUBLE, {_WEEK}, {_YEAR}]
                                     ELSE [1, t / 365.25::DOUBLE, {_WEEK}] END AS x FROM dd),
ij AS (SELECT series_key, y, x, unnest(generate_series(0, len(x) - 1)) AS i FROM xx),
ik AS (SELECT series_key, y, x, i, unnest(generate_series(0, len(x) - 1)) AS j FROM ij)
SELECT series_key, i, j, round(avg(x[i + 1] * x[j + 1]), 6) + 0.0 AS mean_product, round(avg(x[i + 1] * y), 4) + 0.0 AS mean_with_revenue
FROM ik GROUP BY 1, 2, 3
"""))
def forecast_gram(spark, sf_dir):
    """I8: the sums behind the seasonal regression of the three windows, per pair of terms."""
    inp = window_input(prepare.clean_sales(spark, sf_dir, columns=()))
    design = I.design_rows(I.daily_series(inp), I.series_profile(inp)).filter("model = 'seasonal_regression'")
    g = I.gram_rows(design).select("series_key", "i", "xy", "m", F.posexplode("g").alias("j", "v")).where("v IS NOT NULL")
    return g.select("series_key", "i", "j", (F.round(F.col("v") / F.col("m"), 6) + 0.0).alias("mean_product"),
                    (F.round(F.col("xy") / F.col("m"), 4) + 0.0).alias("mean_with_revenue"))


@register("forecast_differences", with_sales(f", inp AS ({_window_sql()})" + DAILY_SQL + """
, y AS (SELECT series_key, t, revenue - lag(revenue, 1) OVER w - lag(revenue, 7) OVER w + lag(revenue, 8) OVER w AS z,
               count(*) OVER (PARTITION BY series_key) AS n FROM daily WINDOW w AS (PARTITION BY series_key ORDER BY t)),
x AS (SELECT *, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 7) OVER w AS z7 FROM y WINDOW w AS (PARTITION BY series_key ORDER BY t))
SELECT series_key, t, round(z, 2) + 0.0 AS z, round(z1, 2) + 0.0 AS z1, round(z2, 2) + 0.0 AS z2, round(z7, 2) + 0.0 AS z7
FROM x WHERE t >= 15 AND n >= 365
"""))
def forecast_differences(spark, sf_dir):
    """The differenced days of the longer windows with their lags."""
    inp = window_input(prepare.clean_sales(spark, sf_dir, columns=()))
    d = I.design_rows(I.daily_series(inp), I.series_profile(inp)).filter("model = 'seasonal_ar'")
    return d.select("series_key", "t", *[(F.round(c, 2) + 0.0).alias(n) for n, c in
                                         (("z", F.col("y")), ("z1", F.col("x")[0]), ("z2", F.col("x")[1]), ("z7", F.col("x")[2]))])


@register("forecast_lag_rows", with_sales(f", inp AS ({_window_sql()})" + DAILY_SQL + """
, y AS (SELECT series_key, t, (revenue - min(revenue) OVER s) / (max(revenue) OVER s - min(revenue) OVER s) AS v, count(*) OVER s AS n
        FROM daily WINDOW s AS (PARTITION BY series_key)),
x AS (SELECT *, avg(v) OVER w AS m, lag(v, 30) OVER o AS v30, lag(v, 1) OVER o AS v1 FROM y
      WINDOW w AS (PARTITION BY series_key ORDER BY t ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY series_key ORDER BY t))
SELECT series_key, t, round(v, 6) AS y, round(m, 6) AS mean_before, round(v30, 6) AS first_before, round(v1, 6) AS last_before,
       t - 30 < greatest(1, floor((n - 30) * 0.85)) AS train
FROM x WHERE t >= 30 AND n > 730
"""))
def forecast_lag_rows(spark, sf_dir):
    """The scaled days of the long window with the 30 days before, and the split in time."""
    inp = window_input(prepare.clean_sales(spark, sf_dir, columns=()))
    d = I.design_rows(I.daily_series(inp), I.series_profile(inp)).filter("model = 'lag_ar'")
    mean = F.expr("(aggregate(x, 0D, (s, v) -> s + v) - x[0]) / (size(x) - 1)")
    return d.select("series_key", "t", F.round("y", 6).alias("y"), F.round(mean, 6).alias("mean_before"),
                    F.round(F.col("x")[1], 6).alias("first_before"), F.round(F.element_at("x", -1), 6).alias("last_before"), "train")


@register("forecast_backtest_models")
def forecast_backtest_models(spark, sf_dir):
    """The error of every tier of the three windows."""
    inp = window_input(prepare.clean_sales(spark, sf_dir, columns=()))
    return I.backtest_models(I.daily_series(inp), I.series_profile(inp))


@register("forecast_hinge_gram", with_sales(f", inp AS ({_window_sql()})" + DAILY_SQL + f"""
, dd AS (SELECT series_key, t, revenue / max(abs(revenue)) OVER s AS y, count(*) OVER s AS n FROM daily WINDOW s AS (PARTITION BY series_key)),
h AS (SELECT series_key, y, list_transform(generate_series(1, {R.HINGES}),
        lambda j: greatest(0.0, t / (n - 1)::DOUBLE - j * {R.HINGE_RANGE}::DOUBLE / {R.HINGES + 1})) AS x FROM dd),
ij AS (SELECT series_key, y, x, unnest(generate_series(0, {R.HINGES - 1})) AS i FROM h),
ik AS (SELECT series_key, y, x, i, unnest(generate_series(0, {R.HINGES - 1})) AS j FROM ij)
SELECT series_key, i, j, round(avg(x[i + 1] * x[j + 1]), 6) + 0.0 AS mean_product, round(avg(x[i + 1] * y), 6) + 0.0 AS mean_with_revenue
FROM ik GROUP BY 1, 2, 3
"""))
def forecast_hinge_gram(spark, sf_dir):
    """I8: the sums of the hinges behind the bending trend, per pair of candidate days, for the three windows."""
    inp = window_input(prepare.clean_sales(spark, sf_dir, columns=()))
    whole = Window.partitionBy("series_key")
    days = I.daily_series(inp).withColumns({"n": F.count(F.lit(1)).over(whole), "size": F.max(F.abs("revenue")).over(whole)})
    rows = R.hinge_rows(days).withColumn("x", F.slice("x", -R.HINGES, R.HINGES))
    g = R.gram(rows, R.HINGES).select("series_key", "i", "xy", "m", F.posexplode("g").alias("j", "v"))
    return g.select("series_key", "i", "j", (F.round(F.col("v") / F.col("m"), 6) + 0.0).alias("mean_product"),
                    (F.round(F.col("xy") / F.col("m"), 6) + 0.0).alias("mean_with_revenue"))


# Given coefficients of a long autoregression, oldest lag first.
_GIVEN = [round(0.9 ** (R.LONG_LAGS - i) * (-1) ** i / 4, 6) for i in range(R.LONG_LAGS)]


@register("forecast_innovations", with_sales(f", inp AS ({_window_sql()})" + DAILY_SQL + f"""
, y AS (SELECT series_key, t, revenue - lag(revenue, 1) OVER w - lag(revenue, 7) OVER w + lag(revenue, 8) OVER w AS z,
               count(*) OVER (PARTITION BY series_key) AS n FROM daily WINDOW w AS (PARTITION BY series_key ORDER BY t)),
e AS (SELECT series_key, t, n, z, z - ({" + ".join(f"{b!r}::DOUBLE * lag(z, {R.LONG_LAGS - i}) OVER w" for i, b in enumerate(_GIVEN))}) AS e
      FROM y WINDOW w AS (PARTITION BY series_key ORDER BY t)),
x AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 7) OVER w AS e7
      FROM (SELECT * FROM e WHERE t >= {8 + R.LONG_LAGS}) WINDOW w AS (PARTITION BY series_key ORDER BY t))
SELECT series_key, t, round(z, 2) + 0.0 AS z, round(e1, 2) + 0.0 AS e1, round(e2, 2) + 0.0 AS e2, round(e7, 2) + 0.0 AS e7
FROM x WHERE t >= {8 + R.LONG_LAGS + 7} AND n >= {I.MIDDLE_TIER_DAYS} AND n <= {I.LONG_TIER_DAYS}
"""))
def forecast_innovations(spark, sf_dir):
    """Residuals of a long autoregression of given coefficients, lagged, as the rows of the moving-average terms."""
    inp = window_input(prepare.clean_sales(spark, sf_dir, columns=()))
    days = I._lagged(I.daily_series(inp), I.series_profile(inp)).where("tier = 'seasonal_ar'")
    rows = R.long_rows(days)
    given = rows.select("series_key").distinct().withColumn("beta", F.array(*[F.lit(b) for b in _GIVEN]))
    d = R.arma_rows(R.innovations(rows, given))
    return d.select("series_key", "t", *[(F.round(c, 2) + 0.0).alias(n) for n, c in
                                         (("z", F.col("y")), ("e1", F.col("x")[3]), ("e2", F.col("x")[4]), ("e7", F.col("x")[5]))])


@register("forecast_rich_models")
def forecast_rich_models(spark, sf_dir):
    """I5 + I8–I10 with hinges, moving-average terms and projections, for the three windows."""
    status, fc, _ = R.forecast(window_input(prepare.clean_sales(spark, sf_dir, columns=())))
    return fc.join(status.select("series_key", "tier"), "series_key")


@register("forecast_status_events", with_events("""
, inp AS (SELECT 'all' AS series_key, date AS ts, revenue AS value FROM ev)
SELECT series_key, NULL::VARCHAR AS tier,
       CAST(max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS BIGINT) AS n_days,
       count(DISTINCT CASE WHEN value > 0 THEN strftime(ts, '%Y-%m') END) AS n_months,
       CASE WHEN count(DISTINCT CASE WHEN value > 0 THEN strftime(ts, '%Y-%m') END) < 3 THEN 'none' END AS model_used,
       count(DISTINCT CASE WHEN value > 0 THEN strftime(ts, '%Y-%m') END) >= 3 AS has_date_data,
       'NOT_ENOUGH' AS warning, 0.0::DOUBLE AS mae
FROM inp GROUP BY series_key
""".replace("NOT_ENOUGH", I.NOT_ENOUGH)))
def forecast_status_events(spark, sf_dir):
    """I5 on events: the 'not enough data' status row."""
    status, _, _ = I.forecast(I.resolve_input(prepare.events_sales(spark, sf_dir)))
    return status


REGION_INP = ", inp AS (SELECT region AS series_key, date AS ts, revenue AS value FROM sales)"


@register("forecast_linear_region", with_sales(REGION_INP + LINEAR_SQL + "SELECT * FROM lin"))
def forecast_linear_region(spark, sf_dir):
    """I1 + I3 + I6 + I7 for one series per region (25 series forecast in one plan)."""
    inp = I.resolve_input(prepare.clean_sales(spark, sf_dir, columns=("region",)), "region")
    return I.linear_forecast(I.daily_series(inp))
