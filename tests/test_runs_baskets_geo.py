"""Committed runs, baskets pruned before they are put together, geography from one scan."""

import random

import pytest
from pyspark.sql import functions as F

from tillwise.operators import features as D
from tillwise.operators import geo as H
from tillwise.operators import report as K
from tillwise.operators import rules as G


def sizes(spark, out, name="segments"):
    return sorted((r["job_id"], r["size"]) for r in K.read_committed(spark, out, name).collect())


def test_a_run_counts_once_all_its_tables_are_written(spark, tmp_path):
    out = str(tmp_path)
    seg = spark.createDataFrame([(1, "a")], "size long, label string")
    rules = spark.createDataFrame([(0.5,)], "lift double")
    for job in ("007", "8"):
        K.commit_run({"segments": seg, "rules": rules}, out, job)
    assert sizes(spark, out) == [("007", 1), ("8", 1)]
    broken = rules.withColumn("lift", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):  # dies between its two tables
        K.commit_run({"segments": seg.withColumn("size", F.lit(99).cast("long")), "rules": broken}, out, "007")
    assert sizes(spark, out) == [("007", 1), ("8", 1)] and K.read_committed(spark, out, "rules").count() == 2
    assert spark.read.parquet(f"{out}/segments").count() == 3
    K.commit_run({"segments": seg.withColumn("size", F.lit(5).cast("long"))}, out, "007")  # a run without rules
    assert sizes(spark, out) == [("007", 5), ("8", 1)]
    assert [r["job_id"] for r in K.read_committed(spark, out, "rules").collect()] == ["8"]
    assert K.sweep_runs(spark, out) == 2  # the replaced run's two tables; the failed one may still be running
    assert sizes(spark, out) == [("007", 5), ("8", 1)] and spark.read.parquet(f"{out}/segments").count() == 3
    assert K.sweep_runs(spark, out, failed_after_hours=-1) >= 1
    assert sizes(spark, out) == [("007", 5), ("8", 1)] and spark.read.parquet(f"{out}/segments").count() == 2
    with pytest.raises(ValueError):
        K.commit_run({"runs": seg}, out, "x")


def test_baskets_pruned_before_they_are_put_together(spark):
    r = random.Random(6)
    lines = []
    for i in range(400):
        for _ in range(r.randint(1, 6)):
            item = f"p{min(int(r.expovariate(0.2)), 30)}" if r.random() < 0.6 else f"rare{r.randrange(2000)}"
            lines += [(f"c{i % 90}", f"t{i}", item)] * r.randint(1, 2)
    lines += [(None, "t1", "p1"), ("c1", None, "p1"), ("c1", "t1", None)]
    sales = spark.createDataFrame(lines, "customer_id string, transaction_id string, product_name string")
    full = G.normalise_baskets(D.build_baskets(sales))
    pruned = D.build_pruned_baskets(sales, 0.02)
    assert pruned.count() == full.count()
    held = pruned.agg(F.sum(F.size("items"))).first()[0]
    assert held < 0.8 * full.agg(F.sum(F.size("items"))).first()[0]
    assert pruned.agg(F.sum("n_items")).first()[0] == full.agg(F.sum(F.size("items"))).first()[0]
    for support in (0.02, 0.05):
        a, b = (sorted((tuple(x["items"]), x["freq"], x["support"]) for x in G.frequent_itemsets(t, support).collect()) for t in (full, pruned))
        assert a == b and len(a) > 8
    assert D.build_pruned_baskets(sales.where("false"), 0.02).count() == 0


def test_geography_reads_the_lines_once(spark):
    rows = [(f"Region {i % 7}", f"c{i % 50}", float(i)) for i in range(1000)]
    geo = spark.createDataFrame(rows, "region string, customer_id string, revenue double")
    stats = H.region_stats(geo)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "customer_id" not in plan and "revenue_share_pct" in plan  # the lines are not in the plan of the ranks
    got = stats.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 8)) and got[-1]["cumulative_share_pct"] == pytest.approx(100, abs=0.5)
    assert H.market_concentration(stats).first()["n_regions"] == 7


def test_geography_column_near_the_bound_is_counted(spark):
    raw = H.RAW_GEO_NAMES
    rows = [(f"a{i}", f"b{i % 500}", "same", None) for i in range(501)]
    df = spark.createDataFrame(rows, f"`{raw[0]}` string, `{raw[1]}` string, region string, `{raw[2]}` string")
    assert H.find_geo_column(df) == raw[1]
    many = spark.range(5000).select(F.col("id").cast("string").alias(raw[0]), (F.col("id") % 3).cast("string").alias(raw[1]))
    assert H.find_geo_column(many) == raw[1] and H.find_geo_column(many.select(raw[0])) is None
    assert H.find_geo_column(many.where("false")) is None
