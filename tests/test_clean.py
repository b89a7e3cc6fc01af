from datetime import datetime

from tillwise.operators import clean as C
from tillwise.operators import features as D

SCHEMA = "customer_id string, date timestamp, price double, quantity double, _ord int"


def test_transactional_filters_and_fence(spark):
    rows = [("a", datetime(2024, 1, 1), 10.0, 1.0, 1), ("b", datetime(2024, 1, 2), 10.0, 2.0, 2),
            ("c", datetime(2024, 1, 3), 11.0, 1.0, 3), ("d", datetime(2024, 1, 4), 12.0, 1.0, 4),
            (None, datetime(2024, 1, 5), 10.0, 1.0, 5), ("e", None, 10.0, 1.0, 6),
            ("f", datetime(2024, 1, 6), 0.0, 1.0, 7), ("g", datetime(2024, 1, 7), 10.0, -1.0, 8),
            ("h", datetime(2024, 1, 8), 1000.0, 1.0, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = C.clean_rows(df, "transactional")
    ids = sorted(r["customer_id"] for r in out.collect())
    # Q1=10, Q3=11.5 over the 5 positive rows -> fence [5.5, 16]; 1000 is out
    assert ids == ["a", "b", "c", "d"]


def test_price_on_fence_is_kept(spark):
    # prices 1,2,3,4 -> Q1=1.75, Q3=3.25, fence hi = 3.25 + 3*1.5 = 7.75
    rows = [(str(i), datetime(2024, 1, 1), float(p), 1.0, i) for i, p in enumerate([1, 2, 3, 4, 7.75, 7.76])]
    out = C.iqr_filter(spark.createDataFrame(rows, SCHEMA), "price", 3.0)
    # with all six rows Q1=2.25, Q3=6.8125 -> fence [-11.44, 20.5]; everything stays
    assert out.count() == 6
    rows2 = [(str(i), datetime(2024, 1, 1), float(p), 1.0, i) for i, p in enumerate([1, 2, 3, 4])]
    lo, hi = C.iqr_fences(spark.createDataFrame(rows2, SCHEMA))
    assert (lo, hi) == (1.75 - 4.5, 3.25 + 4.5)
    edge = spark.createDataFrame(rows2 + [("x", datetime(2024, 1, 1), hi, 1.0, 9)], SCHEMA)
    assert C.iqr_filter(edge).filter("customer_id = 'x'").count() == 1


def test_unpack_shorter_lists_and_placeholders(spark):
    df = spark.createDataFrame(
        [("U1,U2,U3", "R1,R2,R3", "Ann,Bob", "P1", 1), ("nan", "R9", None, "P2", 2), (None, None, None, "P3", 3)],
        "customer_id string, transaction_id string, user_name string, product_id string, _ord int")
    out = sorted(((r["customer_id"], r["transaction_id"], r["user_name"], r["product_id"])
                  for r in C.unpack_packed_rows(df).collect()), key=repr)
    assert out == sorted([("U1", "R1", "Ann", "P1"), ("U2", "R2", "Bob", "P1"), ("U3", "R3", None, "P1"),
                          (None, "R9", None, "P2")], key=repr)


def test_review_cleaning_dedupe_keep_first_and_rating_range(spark):
    df = spark.createDataFrame(
        [("u1", "p1", 4.0, 1), ("u1", "p1", 2.0, 2), ("u2", "p1", 6.0, 3), ("u3", "p2", None, 4),
         ("None", "p3", 3.0, 5), ("u4", "", 3.0, 6)],
        "customer_id string, product_id string, rating double, _ord int")
    out = {(r["customer_id"], r["product_id"]): r["rating"] for r in C.clean_rows(df, "review").collect()}
    assert out == {("u1", "p1"): 4.0, ("u3", "p2"): None}


def test_string_formats_and_coercion(spark):
    df = spark.createDataFrame([("₹1,099", "₹1,499", "64%", "4.2 out of 5 stars", "24,269", "A|B", "1.5d")],
                               "price string, actual_price string, discount_pct string, rating string, "
                               "quantity string, category string, product_id string")
    r = C.coerce_types(C.clean_string_formats(df)).first()
    assert (r["price"], r["actual_price"], r["discount_pct"], r["rating"], r["quantity"], r["category"]) == \
           (1099.0, 1499.0, 64.0, 4.2, 24269.0, "A")
    assert r["product_id"] == "1.5d"
    feats = D.engineer_features(C.coerce_types(C.clean_string_formats(df)), "review").first()
    assert feats["discount_amount"] == 400.0 and feats["revenue"] == 1099.0 * 24269.0
