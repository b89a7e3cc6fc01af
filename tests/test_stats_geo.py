from datetime import datetime

from tillwise.operators import geo as H
from tillwise.operators import stats as E

S = "customer_id string, product_name string, category string, region string, date timestamp, revenue double, _ord int"


def _sales(spark, rows):
    return spark.createDataFrame(rows, S)


def test_mom_growth_rules(spark):
    one = _sales(spark, [("a", "p", "c", "X", datetime(2024, 1, 5), 10.0, 1)])
    assert E.mom_growth(E.monthly_revenue(one)).first()[0] == 0.0
    two = _sales(spark, [("a", "p", "c", "X", datetime(2024, 1, 5), 10.0, 1),
                         ("a", "p", "c", "X", datetime(2024, 2, 5), 15.0, 2)])
    assert E.mom_growth(E.monthly_revenue(two)).first()[0] == 50.0


def test_top_k_ties_broken_by_key(spark):
    rows = [("a", p, "c", "X", datetime(2024, 1, 1), 5.0, i) for i, p in enumerate("edcba")]
    top = E.top_products(_sales(spark, rows), 3).orderBy("rank").collect()
    assert [r["product_name"] for r in top] == ["a", "b", "c"]


def test_one_region_has_no_geography(spark):
    rows = [("a", "p", "c", "Only", datetime(2024, 1, 1), 1.0, i) for i in range(10)]
    assert H.find_geo_column(_sales(spark, rows)) is None


def test_region_shares_hhi_and_home_region(spark):
    rows = [("a", "p", "c", "new york", datetime(2024, 1, 1), 60.0, 1),
            ("a", "p", "c", "BOSTON", datetime(2024, 1, 2), 20.0, 2),
            ("b", "q", "c", "boston", datetime(2024, 2, 1), 20.0, 3),
            ("c", "q", "c", "unknown", datetime(2024, 2, 1), 20.0, 4),
            ("c", "q", "c", None, datetime(2024, 2, 1), 20.0, 5)]
    geo = H.clean_geo(_sales(spark, rows), "region")
    stats = {r["region"]: r for r in H.region_stats(geo).collect()}
    assert set(stats) == {"New York", "Boston"}
    assert stats["New York"]["revenue_share_pct"] == 60.0 and stats["Boston"]["cumulative_share_pct"] == 100.0
    conc = H.market_concentration(H.region_stats(geo)).first()
    assert conc["hhi"] == 5200.0 and conc["label"] == "Highly concentrated" and conc["top3_share"] == 100.0
    homes = {r["customer_id"]: r["region"] for r in H.home_regions(geo).collect()}
    assert homes == {"a": "New York", "b": "Boston"}


def test_map_names_and_tiers(spark):
    rows = [("a", "p", "c", r, datetime(2024, 1, 1), float(v), i)
            for i, (r, v) in enumerate([("usa", 50), ("uk", 30), ("france", 20)])]
    geo = H.clean_geo(_sales(spark, rows), "region")
    got = {r["region"]: (r["map_name"], r["tier"]) for r in H.map_regions(H.region_stats(geo)).collect()}
    assert got == {"Usa": ("United States of America", 0), "Uk": ("United Kingdom", 2), "France": ("France", 4)}


def test_full_stats_transaction_fallbacks(spark):
    rows = [("a", datetime(2024, 1, 1), 10.0), ("a", datetime(2024, 1, 1), 5.0), ("a", datetime(2024, 2, 1), 1.0),
            ("b", datetime(2024, 3, 1), 2.0)]
    df = spark.createDataFrame(rows, "customer_id string, date timestamp, revenue double")
    r = E.full_stats(df, "transactional").first()
    # no transaction id: distinct (customer, date) pairs
    assert r["total_transactions"] == 3 and r["months_of_data"] == 3 and r["total_revenue"] == 18.0
    r2 = E.full_stats(df.drop("date"), "review").first()
    assert r2["total_transactions"] == 4 and r2["date_start"] == "N/A" and r2["mom_growth_pct"] == 0.0
    assert r2["silhouette_label"] == "weak" and r2["total_reviews"] == 4
