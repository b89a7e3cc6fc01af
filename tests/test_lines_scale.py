"""Tables of all lines: parsed once, spread before parsing, mined in tasks of bounded size."""

from pyspark.sql import functions as F

from tillwise.functions import numeric as N
from tillwise.functions import text as T
from tillwise.operators import rules as G
from tillwise.plans import prepare
from tillwise.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_catalog_filters_read_parsed_prices(spark):
    prepare.release()
    plan = _plan(prepare.catalog_sales(spark, SF).select("customer_id", "revenue"))
    typed = prepare._CACHE[prepare._key(spark, SF, "catalog_typed")]
    assert {"price", "product_id"} <= set(typed.columns) and plan.index("price") < plan.index("InMemoryRelation")
    assert typed.count() == tables.read_table(spark, SF, "lineitem").count()
    prepare.release()


def test_catalog_lines_are_dealt_before_their_text_is_made(spark):
    rows = tables.catalog_raw_from_tables(spark, SF, 7)
    assert "RepartitionByExpression" in _plan(rows)
    assert rows.exceptAll(tables.catalog_raw_from_tables(spark, SF)).isEmpty()


def test_baskets_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(G, "BASKETS_PER_TASK", 10)
    widths = []

    class Fp(G.FPGrowth):
        def fit(self, df):
            widths.append(df.rdd.getNumPartitions())
            return super().fit(df)

    monkeypatch.setattr(G, "FPGrowth", Fp)
    tx = spark.createDataFrame([(["a", "b"] if i % 2 else ["a", "c"],) for i in range(200)], "items array<string>").coalesce(1)
    got = {(tuple(r["items"]), r["freq"], r["support"]) for r in G.frequent_itemsets(tx, 0.5).collect()}
    assert widths == [20]
    assert got == {(("a",), 200, 1.0), (("b",), 100, 0.5), (("c",), 100, 0.5), (("a", "b"), 100, 0.5), (("a", "c"), 100, 0.5)}


def test_money_and_numbers_read_as_before(spark):
    texts = ["₹1,299", " $ 5 ", "€\t3.5\n", "£-2e3", "1.5d", "nan", "NaN", "", "1e999", "Infinity", None, "\x0b7\x0c8\r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    old = F.regexp_replace("t", r"[₹$€£,\s]", "")
    both = df.select(old.alias("a"), T.strip_currency("t").alias("b"), N.to_number(T.strip_currency("t")).alias("v")).collect()
    assert all(r["a"] == r["b"] for r in both)
    assert [r["v"] for r in both] == [1299.0, 5.0, 3.5, -2000.0, None, None, None, None, float("inf"), None, None, 78.0]


def test_trees_take_only_items_of_frequent_pairs(spark, monkeypatch):
    grown = []

    class Fp(G.FPGrowth):
        def fit(self, df):
            grown.extend(sorted(r["items"]) for r in df.collect())
            return super().fit(df)

    monkeypatch.setattr(G, "FPGrowth", Fp)
    # every item is frequent, no pair is: nothing is left to grow trees of
    apart = spark.createDataFrame([([f"i{i % 8}", f"i{(i + 1 + i // 8) % 8}"],) for i in range(56)], "items array<string>")
    assert {(tuple(r["items"]), r["freq"]) for r in G.frequent_itemsets(apart, 0.2).collect()} == {((f"i{k}",), 14) for k in range(8)}
    assert grown == []
    tx = spark.createDataFrame([(["a", "b", f"x{i}"],) for i in range(6)] + [(["c", "a"],), (["d", "c"],), (["c", "d"],), ([],)], "items array<string>")
    got = {(tuple(r["items"]), r["freq"]) for r in G.frequent_itemsets(tx, 0.2).collect()}
    assert got == {(("a",), 7), (("b",), 6), (("c",), 3), (("d",), 2), (("a", "b"), 6), (("c", "d"), 2)}
    assert sorted(grown) == [["a", "b"]] * 6 + [["c", "d"]] * 2
