"""Bending trends, moving-average terms and the non-linear tier, on series with planted structure."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.operators import forecast as I
from tillwise.operators import forecast_rich as R


def daily(spark, **series):
    start = datetime(2022, 3, 5)
    rows = [(k, start + timedelta(days=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return I.daily_series(spark.createDataFrame(rows, "series_key string, ts timestamp, value double"))


def profile(spark, *rows):
    return spark.createDataFrame([(k, True, t, n, False) for k, t, n in rows],
                                 "series_key string, eligible boolean, tier string, n_days long, short_history boolean")


def path(points, model):
    return [r["predicted"] for r in points.where(F.col("model") == model).orderBy("step").collect()]


def test_shrunk_changes_meet_the_conditions_of_an_l1_minimum():
    r = np.random.default_rng(2)
    for _ in range(5):
        n = 160
        t = np.arange(n) / (n - 1)
        x = np.column_stack([np.ones(n), t, *[np.maximum(0, t - j * R.HINGE_RANGE / (R.HINGES + 1)) for j in range(1, R.HINGES + 1)]])
        y = 0.4 + 0.3 * t - 1.5 * np.maximum(0, t - r.uniform(0.2, 0.7)) + r.normal(0, 0.02, n)
        b = R.shrunk_changes(x.T @ x, x.T @ y, y @ y, n)
        resid = y - x @ b
        weight = (resid @ resid) / n / R.CHANGE_SCALE
        slope = x.T @ resid
        assert np.abs(slope[:2]).max() < 1e-3
        change = b[2:]
        assert (np.abs(slope[2:]) <= weight * 1.1 + 1e-4).all()
        assert np.count_nonzero(change) < R.HINGES
        for j in np.flatnonzero(change):
            assert np.sign(slope[2 + j]) == np.sign(change[j]) and abs(slope[2 + j]) > 0.8 * weight


def test_a_planted_bend_is_found_and_followed(spark):
    rng = np.random.default_rng(4)
    t = np.arange(300 + 60)
    line = 500 + 2.0 * t - 5.0 * np.maximum(0, t - 150) + 40 * np.sin(2 * np.pi * t / 7)
    y = line + rng.normal(0, 10, len(t))
    prof = profile(spark, ("s", "seasonal_regression", 300))
    days = daily(spark, s=y[:300])
    fits = R.rich_fits(days, prof)
    fit = fits.first()
    assert fit["model"] == "hinge_regression"
    change = np.array(fit["beta"][-R.HINGES:])
    at = (np.arange(1, R.HINGES + 1) * R.HINGE_RANGE / (R.HINGES + 1) * 299)
    assert np.abs(change)[np.abs(at - 150) < 40].sum() > 0.8 * np.abs(change).sum() and change.sum() < 0
    bent = np.array(path(R.rich_points(fits, 60), "hinge_regression"))
    straight = np.array(path(I._forecast_points(I.series_fits(days, prof), 60), "seasonal_regression"))
    want = np.maximum(line[300:], 0)
    assert np.abs(bent - want).mean() < 30 and np.abs(bent - want).mean() < 0.2 * np.abs(straight - want).mean()


def test_planted_moving_average_terms_are_recovered(spark):
    rng = np.random.default_rng(7)
    n = 720
    e = rng.normal(0, 5, n + 30)
    z = np.array([e[i] + 0.85 * e[i - 1] for i in range(8, n + 30)])
    y = list(rng.normal(3000, 3, 8))
    for v in z[:n - 8]:
        y.append(y[-1] + y[-7] - y[-8] + v)
    y = np.array(y) - min(y) + 100
    prof = profile(spark, ("s", "seasonal_ar", n))
    days = daily(spark, s=y)
    fit = R.rich_fits(days, prof).first()
    assert fit["model"] == "seasonal_arma"
    assert abs(fit["beta"][3] - 0.85) < 0.15 and abs(fit["beta"][2]) < 0.2
    plain = next(r for r in I.series_fits(days, prof).collect() if r["model"] == "seasonal_ar")
    assert fit["mae"] < 0.95 * plain["mae"]
    # the two stages and the roll-forward against numpy
    zz = y[8:] - y[7:-1] - y[1:-7] + y[:-8]
    X = np.column_stack([zz[21 - k:len(zz) - k] for k in range(21, 0, -1)])
    shock = zz[21:] - X @ I._solve(X.T @ X, X.T @ zz[21:], 1e-8)
    assert np.allclose(fit["etail"], shock[-7:], atol=1e-4)
    a, b = zz[21:], np.array(fit["beta"])
    x2 = np.column_stack([v[7 - k:len(a) - k] for v in (a, shock) for k in (1, 2, 7)])
    own, used = R.best_order(x2.T @ x2, x2.T @ a[7:], a[7:] @ a[7:], len(a) - 7)
    assert np.allclose(b, own, atol=1e-5) and used == fit["free"]
    got = path(R.rich_points(R.rich_fits(days, prof), 20), "seasonal_arma")
    level, dz, de = list(y), list(zz), list(shock)
    for _ in range(20):
        nxt = b @ [dz[-1], dz[-2], dz[-7], de[-1], de[-2], de[-7]]
        level.append(level[-1] + level[-7] - level[-8] + nxt)
        dz.append(nxt)
        de.append(0.0)
    assert np.allclose(got, np.maximum(level[-20:], 0), atol=1e-3)


def test_projections_beat_lags_on_a_non_linear_series(spark):
    rng = np.random.default_rng(1)
    v = [0.3]
    for _ in range(899):
        v.append(min(max(3.7 * v[-1] * (1 - v[-1]) + rng.normal(0, 0.005), 0.01), 0.99))
    linear = 500 + np.cumsum(rng.normal(0, 1, 900))
    prof = profile(spark, ("bent", "lag_ar", 900), ("walk", "lag_ar", 900))
    days = daily(spark, bent=1000 * np.array(v), walk=linear)
    rich = {r["series_key"]: r for r in R.rich_fits(days, prof).collect()}
    plain = {r["series_key"]: r for r in I.series_fits(days, prof).where("model = 'lag_ar'").collect()}
    assert rich["bent"]["mae"] < 0.4 * plain["bent"]["mae"] and rich["bent"]["free"] > 31
    assert rich["walk"]["mae"] < 1.05 * plain["walk"]["mae"]
    points = R.rich_points(R.rich_fits(days, prof), 30)
    assert points.groupBy("series_key").count().collect() and points.where("predicted > 1200").count() == 0


def test_forecast_uses_the_richer_model_or_keeps_the_plain_one(spark):
    def series(key, days, start=datetime(2023, 1, 1)):
        return [(key, start + timedelta(days=d), 100.0 + d + (30.0 if d % 7 == 5 else 0.0)) for d in range(days)]
    rows = series("long", 800) + series("mid", 400) + series("short", 120) + series("few", 45, datetime(2023, 1, 20)) + series("tiny", 20)
    inp = spark.createDataFrame(rows, "series_key string, ts timestamp, value double")
    status, fc, _ = R.forecast(inp, 40)
    got = {r["series_key"]: r for r in status.collect()}
    assert {k: r["model_used"] for k, r in got.items()} == {"long": "random_features", "mid": "seasonal_arma", "short": "hinge_regression",
                                                            "few": "seasonal_regression", "tiny": "none"}
    assert {r["series_key"]: r["count"] for r in fc.groupBy("series_key").count().collect()} == {"long": 40, "mid": 40, "short": 40, "few": 40}
    assert fc.where("lower > predicted OR predicted > upper OR lower < 0").count() == 0
    assert "45 days" in fc.where("series_key = 'few'").first()["warning"] and fc.where("series_key = 'mid'").first()["warning"] is None
    last = {r["series_key"]: r["predicted"] for r in fc.where("step = 1").collect()}
    assert last["mid"] == pytest.approx(500, abs=40) and last["short"] == pytest.approx(220, abs=15)
    assert R.forecast(inp.where("false"), 5)[1].count() == 0
