from datetime import datetime

from pyspark.sql import functions as F

from tillwise.operators import features as D


def test_rfm_recency_uses_elapsed_time(spark):
    # last purchase 2024-01-10 18:00, snapshot = max date (2024-01-10 18:00) + 1 day
    rows = [("a", "t1", datetime(2024, 1, 10, 18), 2.0), ("b", "t2", datetime(2024, 1, 9, 20), 3.0),
            ("b", "t3", datetime(2024, 1, 1, 8), 5.0), ("b", "t3", datetime(2024, 1, 1, 8), 1.0)]
    df = spark.createDataFrame(rows, "customer_id string, transaction_id string, date timestamp, revenue double")
    got = {r["customer_id"]: (r["frequency"], r["monetary"], r["recency"]) for r in D.rfm_transactional(df).collect()}
    assert got["a"] == (1, 2.0, 1)
    assert got["b"] == (2, 9.0, 1)  # 22h + 1 day elapsed -> 1 whole day (datediff would say 2)


def test_review_rfm_half_even_and_defaults(spark):
    rows = [("a", "p1", 2.0, 3.875), ("a", "p2", 3.0, None), ("b", "p1", None, None)]
    df = spark.createDataFrame(rows, "customer_id string, product_id string, revenue double, rating double")
    got = {r["customer_id"]: (r["frequency"], r["monetary"], r["recency"]) for r in D.rfm_review(df).collect()}
    assert got["a"] == (2, 5.0, 22.0)   # (5 - 3.875) * 20 = 22.5 -> half-even 22
    assert got["b"] == (1, 0.0, 0.0)    # empty-group sum -> 0, missing rating -> 0


def test_robust_scale_zero_spread_divides_by_one(spark):
    rows = [(str(i), 3, float(i * 10), float(i)) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "customer_id string, frequency long, monetary double, recency double")
    out = D.robust_scale(df).orderBy("customer_id").collect()
    assert all(r["frequency_scaled"] == 0.0 for r in out)   # flat frequency: IQR 0 -> /1
    rec = [r["recency_scaled"] for r in out]
    assert rec[3] == 0.0 and abs(rec[0] + 1.0) < 1e-12     # (1 - 4) / (5.5 - 2.5)


def test_baskets_keep_line_count_and_dedupe_items(spark):
    rows = [("c", "t1", "x", 1), ("c", "t1", "x", 2), ("c", "t2", "y", 3), ("c", "t3", "x", 4), ("c", "t3", "y", 5)]
    df = spark.createDataFrame(rows, "customer_id string, transaction_id string, product_name string, _ord int")
    got = {r["basket_key"]: (r["items"], r["n_lines"]) for r in D.build_baskets(df).collect()}
    assert got == {"t1": (["x"], 2), "t3": (["x", "y"], 2)}
    singles = D.build_baskets(df, keep_singles=True).count()
    assert singles == 3


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0, 2.0)], "date timestamp, quantity double, price double")
    r = D.engineer_features(df, "transactional").first()
    assert r["day_of_week"] == 0 and r["month"] == 1 and r["revenue"] == 2.0
