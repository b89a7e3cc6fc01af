"""Distributed rank, report sections, stored parts."""

import json
import random

from pyspark.sql import functions as F

from tillwise.functions.ranking import ranked
from tillwise.operators import geo as H
from tillwise.operators import report as K
from tillwise.operators import segment as S
from tillwise.operators import stats as E
from tillwise.plans import prepare

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_and_running_sums_over_partitions(spark):
    r = random.Random(5)
    rows = [(f"k{i:03d}", float(r.randint(0, 40))) for i in range(300)]
    got = ranked(spark.createDataFrame(rows, "k string, v double").repartition(7), [F.col("v").desc(), F.col("k")], {"v": "run"}).collect()
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert [(x["k"], x["rank"]) for x in sorted(got, key=lambda x: x["rank"])] == [(k, i + 1) for i, (k, _) in enumerate(want)]
    total = 0.0
    for x in sorted(got, key=lambda x: x["rank"]):
        total += x["v"]
        assert abs(x["run"] - total) < 1e-9
    assert ranked(spark.createDataFrame([], "k string, v double"), [F.col("v")], {"v": "run"}).count() == 0


def test_regions_and_maps_need_no_single_partition(spark):
    sales = prepare.clean_sales(spark, SF)
    stats = H.region_stats(H.clean_geo(sales))
    assert "SinglePartition" not in plan(stats)
    pts = prepare.customer_rfm(spark, SF).select("customer_id", F.col("recency_scaled").alias("x"), F.col("monetary_scaled").alias("y"))
    scaled = S.map_scaled(pts)
    assert "Window" not in plan(scaled)
    assert scaled.count() == prepare.customer_rfm(spark, SF).count()


def test_distinct_counts_do_not_expand_the_rows(spark):
    sales = prepare.clean_sales(spark, SF)
    assert "Expand" not in plan(E.dataset_summary(sales, raw=prepare.raw_sales(spark, SF)))
    assert "Expand" not in plan(E.full_stats(sales, raw=prepare.raw_sales(spark, SF)))


def test_geo_column_rule(spark):
    def pick(**cols):
        n = max(map(len, cols.values()))
        rows = [tuple((v[i % len(v)]) for v in cols.values()) for i in range(n)]
        return H.find_geo_column(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)))

    raw = H.RAW_GEO_NAMES[0]
    assert pick(region=["a", "b"], x=["1"]) == "region"
    assert pick(region=["a", None], **{raw: ["p", "q"]}) == raw
    assert pick(region=[f"r{i}" for i in range(700)]) == "region"
    assert pick(**{raw: [f"r{i}" for i in range(501)]}) is None
    assert pick(**{raw: [f"r{i}" for i in range(500)]}) == raw
    assert pick(x=["1"]) is None


def _report(spark, **more):
    job = F.lit("j")
    summary = spark.createDataFrame([("j", 3, 4, 1234.5, 10.0, "N/A", "N/A")], "job_id string, total_customers long, total_transactions long, "
                                    "total_revenue double, avg_order_value double, date_start string, date_end string")
    none = {"profiles": "job_id string, label string, pct_of_customers double, size long, avg_monetary double, avg_recency_days double, "
                        "avg_frequency double, cluster_id int",
            "rules": "job_id string, antecedents array<string>, consequents array<string>, confidence double, lift double, rank int",
            "monthly": "job_id string, month string, total_revenue double",
            "top_products": "job_id string, product_name string, total_revenue double, rank int"}
    frames = {k: more.pop(k, None) for k in none}
    frames = {k: spark.createDataFrame([], none[k]) if v is None else v for k, v in frames.items()}
    one = spark.range(1)
    return K.build_report(summary, frames["profiles"], frames["rules"], frames["monthly"], frames["top_products"],
                          one.select(job.alias("job_id"), F.lit(0.0).alias("score")),
                          one.select(job.alias("job_id"), F.lit("general").alias("focus")), **more).first()["report"]


def test_report_of_dateless_data_lists_category_revenue(spark):
    share = spark.createDataFrame([("j", f"c{i}", 100.0 - i, i + 1) for i in range(7)], "job_id string, category string, revenue double, rank int")
    text = _report(spark, category_revenue=share)
    assert "## Category Revenue Distribution\n- **c0**: $100.00\n" in text and "**c4**" in text and "**c5**" not in text
    assert "No trend data" not in text
    assert "## Revenue Trends\nNo trend data available." in _report(spark)


def test_report_names_units_and_categories(spark):
    monthly = spark.createDataFrame([("j", "2024-01", 10.0), ("j", "2024-02", 15.0)], "job_id string, month string, total_revenue double")
    top = spark.createDataFrame([("j", "Bolt", 25.0, 1, 7), ("j", None, 5.0, 2, None)],
                                "job_id string, product_name string, total_revenue double, rank int, total_quantity long")
    cats = spark.createDataFrame([("j", "b"), ("j", "a"), ("j", "a"), ("j", None)], "job_id string, category string")
    text = _report(spark, monthly=monthly, top_products=top, category_monthly=cats)
    assert "- Bolt: $25.00 (7 units)\n- Unknown Product: $5.00 (0 units)" in text
    assert "Categories with monthly data: a, b" in text and "+50.0%" in text


def test_parts_of_jobs_in_every_state(spark, tmp_path):
    out = str(tmp_path)
    ins = spark.createDataFrame([("done", "review", "2024-01-01", None, None), ("geo", "transactional", "2024-01-01", "[1]", '{"a":1}')],
                                "job_id string, dataset_type string, created_at string, forecast_data string, geo_data string")
    jobs = spark.createDataFrame([("done", "completed", "2024-01-01"), ("geo", "completed", "2024-01-02"), ("bare", "completed", "2024-01-03"),
                                  ("late", "pending", "2024-01-04")], "job_id string, status string, created_at string")
    ins.write.parquet(f"{out}/insight")
    jobs.write.parquet(f"{out}/jobs")

    def look(part):
        return {r["job_id"]: (r["code"], r[part]) for r in K.lookup_part(spark, out, ["done", "geo", "bare", "late", "no", "no"], part).collect()}

    assert look("forecast_data") == {"done": (404, None), "geo": (200, "[1]"), "bare": (404, None), "late": (400, None), "no": (404, None)}
    assert look("geo_data") == {"done": (200, '{"has_geo_data":false}'), "geo": (200, '{"a":1}'), "bare": (404, None), "late": (400, None),
                                "no": (404, None)}


def test_insight_holds_every_part_and_every_map_point(spark, tmp_path):
    out = str(tmp_path)
    summ = spark.createDataFrame([(3, 10.0)], "total_customers long, total_revenue double")
    prof = spark.createDataFrame([(0, "Champions", 3)], "cluster_id int, label string, size long")
    rules = spark.createDataFrame([], "antecedents array<string>, consequents array<string>, lift double")
    rows = [(i / 4, -i / 4, i % 2, None if i % 5 == 0 else "Loyal", f"c{i % 90}", 1.5 * i, i, 2) for i in range(100)]
    rows += [rows[7], rows[8]]
    points = spark.createDataFrame(rows, K.MAP_POINT)
    months = spark.createDataFrame([("2024-01", 10.0), ("2024-02", 15.0)], "month string, total_revenue double")
    cats = spark.createDataFrame([("a", "2024-01", 10.0)], "category string, month string, revenue double")
    report = spark.createDataFrame([("job", "text")], "job_id string, report string")
    row = K.insight_row(spark, "1", "transactional", summ, prof, rules, 1, 0.25, "2026-01-01 00:00:00", map_points=points, report=report,
                        trend={"monthly_revenue": months, "category_monthly": cats, "none": None}, forecast=months, geo={"region_stats": cats}).first()
    trend = json.loads(row["trend_data"])
    assert [m["month"] for m in trend["monthly_revenue"]] == ["2024-01", "2024-02"] and trend["category_monthly"][0]["category"] == "a"
    assert "none" not in trend and len(json.loads(row["forecast_data"])) == 2 and len(json.loads(row["geo_data"])["region_stats"]) == 1
    assert row["report_text"] == "text" and json.loads(row["map_data"])[0]["points"] == 102
    parts = K.map_parts(points, 10)
    K.write_insights({"customer_map": parts}, out, "1")
    K.write_insights({"customer_map": K.map_parts(points.limit(0))}, out, "2")
    assert parts.count() > 5 and parts.agg(F.max("n_points")).first()[0] < 30
    back = K.lookup_map(spark, out, ["1"])
    assert back.select("job_id").distinct().collect() == [("1",)]
    assert sorted(map(repr, back.drop("job_id").collect())) == sorted(map(repr, points.collect()))
    assert K.lookup_map(spark, out).count() == 102
