from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tillwise.operators import forecast as I


def _inp(spark, days, key="s", start=datetime(2023, 1, 1), skip=()):
    rows = []
    for d in range(days):
        if d in skip:
            continue
        rows.append((key, start + timedelta(days=d, hours=13), 100.0 + d + (30.0 if d % 7 == 5 else 0.0)))
    return spark.createDataFrame(rows, "series_key string, ts timestamp, value double")


def test_daily_series_fills_gaps_with_zero(spark):
    d = I.daily_series(_inp(spark, 10, skip={3, 4})).orderBy("t").collect()
    assert [r["t"] for r in d] == list(range(10))
    assert d[3]["revenue"] == 0.0 and d[4]["revenue"] == 0.0


def test_linear_matches_polyfit_and_band(spark):
    inp = _inp(spark, 120)
    daily = I.daily_series(inp)
    fc = I.linear_forecast(daily).orderBy("step").collect()
    assert len(fc) == 180
    y = np.array([r["revenue"] for r in daily.orderBy("t").collect()])
    x = np.arange(len(y))
    slope, icpt = np.polyfit(x, y, 1)
    resid = y - (slope * x + icpt)
    dow = {}
    for i, r in enumerate(daily.orderBy("t").collect()):
        dow.setdefault(r["day"].weekday(), []).append(resid[i])
    last = daily.agg(F.max("day")).first()[0]
    want0 = max(0.0, slope * len(y) + icpt + np.mean(dow[(last + timedelta(days=1)).weekday()]))
    assert abs(fc[0]["predicted"] - round(want0, 2)) <= 0.011
    assert all(r["lower"] <= r["predicted"] <= r["upper"] for r in fc)


def test_profile_tiers_and_not_enough_data(spark):
    inp = (_inp(spark, 800, "long").unionByName(_inp(spark, 400, "mid")).unionByName(_inp(spark, 50, "short", start=datetime(2023, 1, 20)))
           .unionByName(_inp(spark, 20, "tiny")))
    prof = {r["series_key"]: r for r in I.series_profile(inp).collect()}
    assert prof["long"]["tier"] == "lag_ar" and prof["mid"]["tier"] == "seasonal_ar"
    assert prof["short"]["tier"] == "seasonal_regression" and prof["short"]["short_history"]
    assert not prof["tiny"]["eligible"] and prof["tiny"]["tier"] is None


def test_model_forecast_properties(spark):
    inp = _inp(spark, 800, "long").unionByName(_inp(spark, 400, "mid")).unionByName(_inp(spark, 70, "short"))
    status, fc, hist = I.forecast(inp)
    counts = {r["series_key"]: r["count"] for r in fc.groupBy("series_key").count().collect()}
    assert counts == {"long": 180, "mid": 180, "short": 180}
    models = {r["series_key"]: r["model_used"] for r in status.collect()}
    assert models == {"long": "lag_ar", "mid": "seasonal_ar", "short": "seasonal_regression"}
    bad = fc.filter((F.col("lower") > F.col("predicted")) | (F.col("predicted") > F.col("upper"))
                    | (F.col("lower") < 0)).count()
    assert bad == 0


def _profile(spark, *rows):
    return spark.createDataFrame([(k, True, t, n, False) for k, t, n in rows],
                                 "series_key string, eligible boolean, tier string, n_days long, short_history boolean")


def test_series_step_down_their_chain(spark):
    daily = I.daily_series(_inp(spark, 45, "a").unionByName(_inp(spark, 20, "b")).unionByName(_inp(spark, 8, "c")))
    prof = _profile(spark, ("a", "lag_ar", 45), ("b", "seasonal_ar", 20), ("c", "seasonal_ar", 8))
    fc = I.model_forecast(daily, prof, 30)
    got = {r["series_key"]: (r["model_used"], r["n"], r["w"]) for r in
           fc.groupBy("series_key", "model_used").agg(F.count("*").alias("n"), F.first("warning").alias("w")).collect()}
    assert got["a"] == ("lag_ar", 30, None)
    assert got["b"][:2] == ("seasonal_regression", 30) and "fell back to seasonal_regression (too few days)" in got["b"][2]
    assert got["c"][:2] == ("linear_trend", 30) and "fell back to linear_trend" in got["c"][2]
    flat = spark.createDataFrame([("f", datetime(2023, 1, 1) + timedelta(days=i), 5.0) for i in range(60)], "series_key string, ts timestamp, value double")
    out = I.model_forecast(I.daily_series(flat), _profile(spark, ("f", "lag_ar", 60)), 10).collect()
    assert len(out) == 10 and all(abs(r["predicted"] - 5.0) < 0.6 for r in out)


def _series(spark, days):
    rng = np.random.default_rng(3)
    t = np.arange(days)
    y = 200 + 0.2 * t + 25 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 8, days)
    start = datetime(2022, 3, 5)
    df = spark.createDataFrame([("s", start + timedelta(days=int(i)), float(v)) for i, v in enumerate(y)], "series_key string, ts timestamp, value double")
    return y, (start - datetime(1970, 1, 1)).days + t, I.daily_series(df)


def test_gram_sums_and_fits_equal_numpy(spark):
    y, days, daily = _series(spark, 760)
    prof = _profile(spark, ("s", "lag_ar", 760))
    fits = {r["model"]: r for r in I.series_fits(daily, prof).collect()}
    assert set(fits) == {"lag_ar", "seasonal_ar", "seasonal_regression"}

    def fourier(d, period, order):
        return [f(2 * np.pi * k * d / period) for k in range(1, order + 1) for f in (np.sin, np.cos)]

    def solve(X, v, ridge):
        g = X.T @ X
        return np.linalg.solve(g + np.eye(len(g)) * ridge * (np.trace(g) / len(g) + 1), X.T @ v)

    X = np.column_stack([np.ones(760), np.arange(760) / 365.25, *fourier(days, 7.0, 3), *fourier(days, 365.25, 10)])
    b = solve(X, y, 1e-8)
    assert np.allclose(X @ np.array(fits["seasonal_regression"]["beta"]), X @ b, atol=1e-5)
    assert abs(fits["seasonal_regression"]["mae"] - np.abs(y - X @ b).mean()) < 1e-5

    lo, scale = y.min(), y.max() - y.min()
    v = (y - lo) / scale
    X = np.column_stack([np.ones(730)] + [v[j:j + 730] for j in range(30)])
    cut = int(730 * 0.85)
    b = solve(X[:cut], v[30:30 + cut], 1e-4)
    assert np.allclose(fits["lag_ar"]["beta"], b, atol=1e-7)
    assert abs(fits["lag_ar"]["mae"] - scale * np.abs(X[cut:] @ b - v[30 + cut:]).mean()) < 1e-6

    z = np.full(760, np.nan)
    z[8:] = y[8:] - y[7:-1] - y[1:-7] + y[:-8]
    rows = np.arange(15, 760)
    best = None
    for lags in ([7], [1, 7], [1, 2, 7]):
        X = np.column_stack([z[rows - k] for k in lags])
        b = solve(X, z[rows], 1e-8)
        rss = ((z[rows] - X @ b) ** 2).sum()
        aic = len(rows) * np.log(rss / len(rows)) + 2 * (len(lags) + 1)
        if best is None or aic < best[0]:
            best = (aic, dict(zip(lags, b)), np.abs(z[rows] - X @ b).mean())
    assert np.allclose(fits["seasonal_ar"]["beta"], [best[1].get(k, 0.0) for k in I.AR_LAGS], atol=1e-7)
    assert abs(fits["seasonal_ar"]["mae"] - best[2]) < 1e-6

    points = {}
    for r in I._forecast_points(I.series_fits(daily, prof), 40).orderBy("model", "step").collect():
        points.setdefault(r["model"], []).append(r["predicted"])
    yy, zz = list(y), list(z)
    for _ in range(40):
        zz.append(sum(c * zz[len(yy) - k] for k, c in best[1].items()))
        yy.append(yy[-1] + yy[-7] - yy[-8] + zz[-1])
    assert np.allclose(points["seasonal_ar"], np.maximum(yy[-40:], 0), atol=1e-4)
    window, b = list(v[-30:]), np.array(fits["lag_ar"]["beta"])
    for _ in range(40):
        window.append(b[0] + np.dot(b[1:], window[-30:]))
    assert np.allclose(points["lag_ar"], np.maximum(np.array(window[-40:]) * scale + lo, 0), atol=1e-6)


def test_backtest_has_a_row_per_tier(spark):
    _, _, daily = _series(spark, 760)
    got = {r["model_used"]: r for r in I.backtest_models(daily, _profile(spark, ("s", "lag_ar", 760))).collect()}
    assert set(got) == set(I.TIER_ORDER) and all(r["n_points"] == 760 and r["mae"] > 0 for r in got.values())
    assert got["seasonal_regression"]["mae"] < got["linear_trend"]["mae"]


def test_not_enough_months(spark):
    status, fc, _ = I.forecast(_inp(spark, 25))
    s = status.first()
    assert s["model_used"] == "none" and not s["has_date_data"] and fc.count() == 0


def test_horizon_kpis_and_downsample(spark):
    inp = _inp(spark, 120)
    fc = I.linear_forecast(I.daily_series(inp))
    hist = I.monthly_history(inp).select("series_key", F.col("month").alias("date"), "revenue")
    k = {r["horizon"]: r for r in I.horizon_kpis(fc, hist).collect()}
    first30 = [r["predicted"] for r in fc.filter("step <= 30").orderBy("step").collect()]
    assert abs(k[30]["total_forecast"] - round(sum(first30), 2)) < 1e-6
    assert k[30]["forecast_start"] == first30[0] and k[30]["forecast_end"] == first30[-1]
    ds = [r["step"] for r in I.downsample(fc, 90, 30).orderBy("step").collect()]
    assert ds == list(range(1, 91, 3)) + [90]
