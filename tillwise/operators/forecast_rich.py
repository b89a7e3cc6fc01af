"""I8–I10 with a bending trend, moving-average terms and a non-linear long tier.

Each tier of ``forecast`` has a richer model here that is tried first; where it cannot be fitted, the series keeps the
plain chain's forecast with its notice.

* ``hinge_regression`` (short tier): the calendar terms of ``seasonal_regression`` plus a hinge at each of 25 days in
  the first 80 % of the history. The slope changes have a Laplace prior, so most of them are zero: an L1
  coordinate descent on the sums with the calendar terms projected out.
* ``seasonal_arma`` (middle tier): the (1, 7)-difference by its lags and by lagged innovations. The innovations are the
  residuals of a long autoregression; both stages are regressions over Spark rows. The order is one of five, by AIC.
* ``random_features`` (long tier): the 30 scaled days before, and hyperbolic tangents of fixed random projections of
  them. Ridge; the number of projections (none, too) and the ridge are those of least error on the held-out 15 %.

As in ``forecast``, Spark builds the rows, sums XᵀX and Xᵀy per series and measures errors; what runs in numpy is one
p × p system (p ≤ 63) per series and model, the projections of a batch of rows, and a roll-forward from a series' last 30
days.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..session import scratch_table
from . import forecast as I

# ── Fixed values (must equal the reference's) ───────────────────────────────
ARMA_ORDERS = [(1, 1), (2, 1), (1, 2), (2, 2), (0, 1)]  # (p, q) beside the weekly (1, 1, 1, 7)
CHANGE_SCALE = 0.05  # of the Laplace prior on slope changes
# ─────────────────────────────────────────────────────────────────────────────

HINGES, HINGE_RANGE = 25, 0.8
LONG_LAGS, ARMA_MIN_DAYS = 21, 70
AR_PLACES, MA_PLACES = {1: 0, 2: 1, 7: 2}, {1: 3, 2: 4, 7: 5}  # of lags in a row of seasonal_arma
WIDTHS, RIDGES, FEATURE_SEED = (0, 8, 16, 32), (1e-4, 1e-2, 1.0), 20240601
MODELS = {"lag_ar": "random_features", "seasonal_ar": "seasonal_arma", "seasonal_regression": "hinge_regression"}


# ── I8: hinges ───────────────────────────────────────────────────────────────

def hinge_terms(t: Column, n: Column) -> Column:
    """How far a day lies behind each of the candidate days, as a share of the history."""
    span = F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.lit(HINGES)),
                       lambda j: F.greatest(F.lit(0.0), t / span - j * F.lit(HINGE_RANGE) / F.lit(HINGES + 1)))


def hinge_rows(days: DataFrame) -> DataFrame:
    """(series_key, model, t, x, y, train): revenue by calendar terms, then the hinges; y scaled by its largest size."""
    n, t = F.col("n"), F.col("t")
    yearly = n - 1 >= I.YEARLY_MIN_SPAN_DAYS
    x = F.concat(I._regression_row(t, I._epoch_day(F.col("day")), yearly), hinge_terms(t, n))
    return days.where(n >= 2 * HINGES).select("series_key", F.lit("hinge_regression").alias("model"), "t", x.alias("x"),
                                              (F.col("revenue") / F.col("size")).alias("y"), F.lit(True).alias("train"))


def shrunk_changes(g: np.ndarray, xy: np.ndarray, yy: float, m: int, scale: float = CHANGE_SCALE) -> np.ndarray:
    """Coefficients: the last HINGES under a Laplace prior, the others free; noise and coefficients in turn."""
    free = len(xy) - HINGES
    a = g[:free, :free] + np.eye(free) * 1e-8 * (np.trace(g[:free, :free]) / free + 1)
    to_free = np.linalg.solve(a, g[:free, free:])
    base = np.linalg.solve(a, xy[:free])
    h = g[free:, free:] - g[free:, :free] @ to_free  # sums of the hinges with the free terms projected out
    c = xy[free:] - g[free:, :free] @ base
    left = max(yy - base @ xy[:free], 0.0)           # squares left by the free terms alone
    change = np.zeros(HINGES)
    noise = left / m
    for _ in range(5):
        weight = max(noise, 1e-12) / scale
        for _ in range(400):
            before = change.copy()
            for j in range(HINGES):
                pull = c[j] - h[j] @ change + h[j, j] * change[j]
                change[j] = math.copysign(max(abs(pull) - weight, 0.0), pull) / max(h[j, j], 1e-12)
            if np.abs(change - before).max() <= 1e-9 * (1 + np.abs(change).max()):
                break
        noise = max(left - 2 * c @ change + change @ h @ change, 0.0) / m
    return np.concatenate([base - to_free @ change, change])


# ── I9: moving-average terms ─────────────────────────────────────────────────

def long_rows(days: DataFrame) -> DataFrame:
    """Rows of the long autoregression whose residuals stand for the innovations."""
    order = Window.partitionBy("series_key").orderBy("t")
    d = days.where(F.col("n") >= ARMA_MIN_DAYS).withColumn("zlong", F.collect_list("z").over(order.rowsBetween(-LONG_LAGS, -1)))
    return d.where(F.col("t") >= 8 + LONG_LAGS).select("series_key", F.lit("long_ar").alias("model"), "t", F.col("zlong").alias("x"),
                                                       F.col("z").alias("y"), F.lit(True).alias("train"))


def innovations(rows: DataFrame, betas: DataFrame) -> DataFrame:
    """(series_key, t, z, e): residuals of the long autoregression, ``betas`` (series_key, beta) by oldest lag first."""
    return rows.join(betas, "series_key").select("series_key", "t", F.col("y").alias("z"), (F.col("y") - I._dot("x", "beta")).alias("e"))


def arma_rows(shocks: DataFrame) -> DataFrame:
    """Rows of the second stage: lags 1, 2 and 7 of the difference, then of the innovations."""
    order = Window.partitionBy("series_key").orderBy("t")
    x = F.array(*[F.lag(c, k).over(order) for c in ("z", "e") for k in (1, 2, 7)])
    return (shocks.select("series_key", F.lit("seasonal_arma").alias("model"), "t", x.alias("x"), F.col("z").alias("y"), F.lit(True).alias("train"))
            .where(F.get("x", F.lit(5)).isNotNull()))


def best_order(g: np.ndarray, xy: np.ndarray, yy: float, m: int) -> tuple[np.ndarray, int]:
    best = None
    for p, q in ARMA_ORDERS:
        use = sorted({AR_PLACES[k] for k in (*range(1, p + 1), 7)} | {MA_PLACES[k] for k in (*range(1, q + 1), 7)})
        b = I._solve(g[np.ix_(use, use)], xy[use], 1e-8)
        rss = yy - 2 * b @ xy[use] + b @ g[np.ix_(use, use)] @ b
        aic = m * math.log(max(rss, 1e-300) / m) + 2 * (len(use) + 1)
        if best is None or aic < best[0]:
            full = np.zeros(len(xy))
            full[use] = b
            best = aic, full, len(use)
    return best[1], best[2]


# ── I10: random projections ──────────────────────────────────────────────────

def projections() -> tuple[np.ndarray, np.ndarray]:
    """Fixed weights and offsets of the non-linear terms, the same for every series and run."""
    rng = np.random.default_rng(FEATURE_SEED)
    reach = rng.integers(1, I.LOOKBACK + 1, max(WIDTHS))  # how many of the last days a term sees
    w = rng.normal(0, 2.5, (I.LOOKBACK, max(WIDTHS))) / np.sqrt(reach)
    w[np.arange(I.LOOKBACK)[:, None] < I.LOOKBACK - reach[None]] = 0
    return w, rng.normal(0, 1, max(WIDTHS))


def _features(back: np.ndarray) -> np.ndarray:
    w, b = projections()
    return np.hstack([np.ones((len(back), 1)), back, np.tanh((back - 0.5) @ w + b)])


def feature_rows(design: DataFrame) -> DataFrame:
    """The lag rows of the long tier with the projections added."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = _features(np.array(pdf["x"].tolist(), dtype=float)[:, 1:])
                yield pdf.assign(model="random_features", x=list(x))

    rows = design.where("model = 'lag_ar'").select("series_key", "model", "t", "x", "y", "train")
    return rows.mapInPandas(run, "series_key string, model string, t int, x array<double>, y double, train boolean")


def best_width(g: np.ndarray, xy: np.ndarray, held: tuple | None) -> tuple[np.ndarray, int]:
    """Ridge coefficients of the width and ridge with the least squared error on the held-out days."""
    best = None
    for width in WIDTHS:
        p = 1 + I.LOOKBACK + width
        for ridge in RIDGES if width else RIDGES[:1]:
            b = I._solve(g[:p, :p], xy[:p], ridge / p)
            loss = 0.0 if held is None else held[2] - 2 * b @ held[1][:p] + b @ held[0][:p, :p] @ b
            if best is None or loss < best[0] * (1 - 1e-9):
                best = loss, np.concatenate([b, np.zeros(len(xy) - p)]), p
    return best[1], best[2]


# ── fits, forecasts ──────────────────────────────────────────────────────────

def gram(design: DataFrame, terms: int) -> DataFrame:
    """(series_key, model, train, i, g, xy, yy, m): row i of XᵀX and Xᵀy over the training and the held-out days."""
    each = design.select("series_key", "model", "train", "x", "y", F.posexplode("x").alias("i", "xi"))
    return each.groupBy("series_key", "model", "train", "i").agg(
        F.array(*[F.sum(F.col("xi") * F.get("x", F.lit(j))) for j in range(terms)]).alias("g"),
        F.sum(F.col("xi") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("m"))


def solve(grams: DataFrame) -> DataFrame:
    """(series_key, model, beta, free): a series and model whose system has no finite solution is left out."""
    systems = grams.groupBy("series_key", "model").agg(F.sort_array(F.collect_list(F.struct("train", "i", "g", "xy", "yy", "m"))).alias("rows"))

    def part(rows, train):
        rows = [r for r in rows if r["train"] == train]
        if not rows:
            return None
        g = np.array([[v for v in r["g"][:len(rows)]] for r in rows], dtype=float)
        return g, np.array([r["xy"] for r in rows], dtype=float), float(rows[0]["yy"]), int(rows[0]["m"])

    def run(batches):
        for pdf in batches:
            out = []
            for key, model, rows in pdf.itertuples(index=False):
                fitted = part(rows, True)
                if fitted is None:
                    continue
                g, xy, yy, m = fitted
                try:
                    if model == "hinge_regression":
                        beta = shrunk_changes(g, xy, yy, m)
                        free = int(len(beta) - HINGES + np.count_nonzero(beta[-HINGES:]))
                    elif model == "seasonal_arma":
                        beta, free = best_order(g, xy, yy, m)
                    elif model == "random_features":
                        beta, free = best_width(g, xy, part(rows, False))
                    else:
                        beta, free = I._solve(g, xy, 1e-8), len(xy)
                except np.linalg.LinAlgError:
                    continue
                if np.all(np.isfinite(beta)):
                    out.append((key, model, beta.tolist(), free))
            yield pd.DataFrame(out, columns=["series_key", "model", "beta", "free"])

    return systems.mapInPandas(run, "series_key string, model string, beta array<double>, free int")


def _scored(design: DataFrame, fits: DataFrame) -> DataFrame:
    """Fits with mean absolute error (held-out days where there are any), squared error and number of days."""
    e = F.col("y") - I._dot("x", "beta")
    return (design.join(fits, ["series_key", "model"]).withColumn("e", e).groupBy("series_key", "model").agg(
        F.first("beta").alias("beta"), F.first("free").alias("free"),
        F.coalesce(F.avg(F.when(~F.col("train"), F.abs("e"))), F.avg(F.abs("e"))).alias("mae"),
        F.sum(F.col("e") * F.col("e")).alias("sse"), F.count(F.lit(1)).alias("m")))


def rich_fits(daily: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per series: the fit of its tier's richer model and what a forecast starts from."""
    whole = Window.partitionBy("series_key")
    days = I._lagged(daily, profile).withColumn("size", F.greatest(F.max(F.abs("revenue")).over(whole), F.lit(1e-9)))
    days = scratch_table(days, "forecast-rich-days")
    short, middle, long = (days.where(F.col("tier") == k) for k in ("seasonal_regression", "seasonal_ar", "lag_ar"))

    hinge = hinge_rows(short)
    hinge = _scored(hinge, solve(gram(hinge, 2 + 2 * (I.WEEKLY_ORDER + I.YEARLY_ORDER) + HINGES)))

    first = long_rows(middle)
    shocks = scratch_table(innovations(first, solve(gram(first, LONG_LAGS)).select("series_key", "beta")), "forecast-innovations")
    arma = arma_rows(shocks)
    arma = _scored(arma, solve(gram(arma, 6)))
    recent = (shocks.withColumn("_n", F.max("t").over(whole)).where(F.col("t") > F.col("_n") - 7).groupBy("series_key")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "e"))), lambda s: s["e"]).alias("etail")))

    features = feature_rows(I._design(long))
    features = scratch_table(features, "forecast-features")
    features = _scored(features, solve(gram(features, 1 + I.LOOKBACK + max(WIDTHS))))

    last = days.where("t = n - 1").select("series_key", "tier", "n", F.col("day").alias("last_day"), "lo", "scale", "size", "mean_abs",
                                          F.concat("back", F.array("revenue")).alias("tail"), F.concat("zback", F.array("z")).alias("ztail"))
    fits = hinge.unionByName(arma).unionByName(features).join(last, "series_key").join(recent, "series_key", "left")
    unit = F.when(F.col("model") == "hinge_regression", F.col("size")).when(F.col("model") == "random_features", F.col("scale")).otherwise(F.lit(1.0))
    sigma = F.sqrt(F.col("sse") / F.greatest(F.col("m") - F.col("free"), F.lit(1)))
    return fits.withColumn("mae", F.col("mae") * unit).withColumn("sigma", sigma * unit)


def _roll_arma(horizon: int) -> Column:
    """Each day's difference from its lags and the lagged innovations, those to come being zero; then the level."""
    nxt = ("beta[0] * element_at(s.z, -1) + beta[1] * element_at(s.z, -2) + beta[2] * element_at(s.z, -7)"
           " + beta[3] * element_at(s.e, -1) + beta[4] * element_at(s.e, -2) + beta[5] * element_at(s.e, -7)")
    step = (f"struct(concat(s.y, array(element_at(s.y, -1) + element_at(s.y, -7) - element_at(s.y, -8) + {nxt})) AS y, "
            f"concat(s.z, array({nxt})) AS z, concat(s.e, array(0D)) AS e)")
    return F.expr(f"slice(aggregate(sequence(1, {horizon}), struct(tail AS y, ztail AS z, etail AS e), (s, k) -> {step}).y, -{horizon}, {horizon})")


def _rolled_features(fits: DataFrame, horizon: int) -> DataFrame:
    """(series_key, path): the long tier rolled forward over the scaled series, scaled back."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            lo, scale = pdf["lo"].to_numpy()[:, None], pdf["scale"].to_numpy()[:, None]
            days = (np.array(pdf["tail"].tolist(), dtype=float)[:, -I.LOOKBACK:] - lo) / scale
            beta = np.array(pdf["beta"].tolist(), dtype=float)
            for _ in range(horizon):
                nxt = (_features(days[:, -I.LOOKBACK:]) * beta).sum(axis=1, keepdims=True)
                days = np.hstack([days, nxt])
            yield pd.DataFrame({"series_key": pdf["series_key"], "path": list(days[:, -horizon:] * scale + lo)})

    rows = fits.where("model = 'random_features'").select("series_key", "tail", "lo", "scale", "beta")
    return rows.mapInPandas(run, "series_key string, path array<double>")


def rich_points(fits: DataFrame, horizon: int) -> DataFrame:
    """(series_key, model, step, date, predicted, lower, upper, mae), not rounded."""
    step = F.col("step")
    t, zero = F.col("n") - 1 + step, F.lit(0.0)
    yearly = F.col("n") - 1 >= I.YEARLY_MIN_SPAN_DAYS
    x = F.concat(I._regression_row(t, I._epoch_day(F.col("last_day")) + step, yearly), hinge_terms(t, F.col("n")))
    # slopes may go on changing as often and as much as they did: the variance of a sum of such changes by the day
    span = F.greatest(F.col("n") - 1, F.lit(1))
    change = F.expr(f"aggregate(slice(beta, -{HINGES}, {HINGES}), 0D, (s, v) -> s + abs(v)) / {HINGES}")
    drift = F.lit(2 * HINGES / HINGE_RANGE / 3) * change * change * F.pow(step / span, F.lit(3))
    hinge = (fits.where("model = 'hinge_regression'").select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
             .withColumn("x", x).withColumn("p", I._dot("x", "beta") * F.col("size"))
             .withColumn("half", F.lit(I.Z80) * F.sqrt(F.col("sigma") * F.col("sigma") + F.col("size") * F.col("size") * drift)).drop("x"))
    arma = (fits.where("model = 'seasonal_arma' AND size(etail) = 7").select("*", F.posexplode(_roll_arma(horizon)).alias("k", "p"))
            .withColumn("step", F.col("k") + 1).withColumn("half", F.lit(I.Z80) * F.col("sigma") * F.sqrt("step")).drop("k"))
    wide = F.greatest(F.lit(I.MIN_CI_WIDTH), F.col("mae") / (F.col("mean_abs") + F.lit(1e-9)))
    rolled = (fits.join(_rolled_features(fits, horizon), "series_key").select("*", F.posexplode("path").alias("k", "p"))
              .withColumn("step", F.col("k") + 1).withColumn("half", wide * F.greatest("p", zero)).drop("k", "path"))
    every = hinge.unionByName(arma).unionByName(rolled)
    middle = F.when(F.col("model") == "random_features", F.greatest("p", zero)).otherwise(F.col("p"))
    return every.select("series_key", "model", "step", N.day_str(F.date_add("last_day", step)).alias("date"), F.greatest("p", zero).alias("predicted"),
                        F.greatest(middle - F.col("half"), zero).alias("lower"), F.greatest(middle + F.col("half"), zero).alias("upper"), "mae")


def forecast(inp: DataFrame, horizon: int = I.HORIZON_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``forecast.forecast`` with the richer model of each series' tier, where it can be fitted."""
    status, plain, history = I.forecast(inp, horizon)
    prof = scratch_table(I.series_profile(inp), "forecast-profile")
    fits = scratch_table(rich_fits(scratch_table(I.daily_series(inp), "forecast-daily"), prof), "forecast-rich-fits")
    points = scratch_table(rich_points(fits, horizon), "forecast-rich-points")
    good = points.groupBy("series_key").agg(F.bool_and(F.col("predicted").between(-1e300, 1e300) & F.col("mae").between(0, 1e300)).alias("ok"),
                                            F.first("model").alias("rich"), F.first("mae").alias("rich_mae")).where("ok").drop("ok")
    # a notice of the plain chain's own step down does not concern the richer model
    warned = plain.groupBy("series_key").agg(F.first(F.when(~F.contains("warning", F.lit("fell back")), F.col("warning"))).alias("warning"))
    rich = (points.join(good.select("series_key"), "series_key").join(warned, "series_key", "left")
            .select("series_key", F.col("model").alias("model_used"), "step", "date",
                    *[(F.round(c, 2) + 0.0).alias(c) for c in ("predicted", "lower", "upper", "mae")], "warning"))
    rest = plain.join(good.select("series_key"), "series_key", "left_anti").select(*rich.columns)
    status = status.join(good, "series_key", "left").withColumns({
        "model_used": F.coalesce("rich", "model_used"), "mae": F.coalesce(F.round("rich_mae", 2), "mae")}).drop("rich", "rich_mae")
    return status, rich.unionByName(rest), history
