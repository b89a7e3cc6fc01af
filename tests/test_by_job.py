"""K1 over many jobs: grouped quantiles, and every table of a job equal to a run over its lines alone."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.functions.quantile import grouped_quantiles
from tillwise.operators import by_job as J
from tillwise.operators import rules as G
from tillwise.plans import analysis, prepare

SF = "/root/testdata/sf0.001"


def test_grouped_quantiles_equal_numpy(spark):
    r = random.Random(5)
    rows = [(f"g{min(int(r.expovariate(0.4)), 9)}", r.choice([r.random() * 100, float(r.randint(0, 5)), -1e300]), float(r.randint(0, 9))) for _ in range(3000)]
    rows += [("hot", float(i % 777), 1.0) for i in range(4000)] + [("one", 3.5, None), ("none", None, None), ("nan", float("nan"), 2.0), (None, 1.0, 4.0), (None, 3.0, 8.0)]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x["g"]: x for x in grouped_quantiles(spark.createDataFrame(rows, "g string, a double, b double").repartition(5), ["g"], ["a", "b"], probs).collect()}
    for g in {x[0] for x in rows} - {"none"}:
        for c, at in (("a", 1), ("b", 2)):
            v = [x[at] for x in rows if x[0] == g and x[at] is not None and not math.isnan(x[at])]
            want = [None] * len(probs) if not v else list(np.quantile(v, probs))
            have = [got[g][f"{c}_q{i}"] for i in range(len(probs))]
            assert have == pytest.approx(want) if v else have == want, (g, c)
    assert "none" not in got


@pytest.fixture(scope="module")
def sales(spark):
    return prepare.raw_sales(spark, SF).withColumn("shop", (F.col("customer_id").cast("bigint") % 3).cast("string")).persist()


@pytest.fixture(scope="module")
def together(spark, sales):
    few = sales.limit(40).withColumn("shop", F.lit("few"))
    lost = sales.limit(20).withColumn("shop", F.lit(None).cast("string"))
    return analysis.analyse_jobs(sales.unionByName(few).unionByName(lost), "shop", focus="retention")


def table(df, cols):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())


@pytest.mark.parametrize("job", ["0", "1", "2"])
def test_each_job_equals_a_run_over_its_own_lines(sales, together, job):
    alone = analysis.analyse(sales.where(F.col("shop") == job).drop("shop"), focus="retention", segmentation="quantile", job_id=job)
    for name in ("summary", "segments", "customers", "rules", "monthly_revenue", "top_products", "category_monthly", "geo_region_stats",
                 "mom_growth", "report"):
        one, mine = alone.tables[name], together[name].where(F.col("job_id") == job)
        cols = [c for c in one.columns if c not in ("job_id", "_ord")]
        assert set(cols) <= set(mine.columns), name
        assert table(mine, cols) == table(one, cols), name
    assert together["silhouette"].where(F.col("job_id") == job).first()["score"] == pytest.approx(alone.silhouette)
    mine = together["forecast"].where(F.col("job_id") == job)
    cols = [c for c in alone.tables["forecast"].columns if c != "series_key"]
    assert table(mine, cols) == table(alone.tables["forecast"], cols)


def test_small_jobs_are_not_admitted(together):
    jobs = {r["job_id"]: r for r in together["jobs"].collect()}
    assert set(jobs) == {"0", "1", "2", "few"} and not jobs["few"]["admitted"] and jobs["0"]["admitted"]
    assert not together["report"].where("job_id = 'few'").count() and together["report"].count() == 3


def test_every_rung_of_the_ladder_settles_its_own_jobs(spark):
    lines = []
    for i in range(60):  # products that go together; words that do; a keyword; nothing that repeats
        lines += [("prod", f"c{i}", f"t{i}", p) for p in ("pen", "ink")]
        lines += [("lone", f"c{i}", f"t{i}", f"only {i}")]
    for i in range(210):  # every product below the least support
        lines += [("word", f"c{i}", f"t{i}", p) for p in (f"Red {i}", f"Blue {i}")]
    for i in range(12):
        lines += [("near", f"c{i}", f"t{i}", p) for p in ("Electronics", "Home" if i % 2 else "Toys")]
    sales = spark.createDataFrame(lines, "job_id string, customer_id string, transaction_id string, product_name string")
    found = J.run_rules(J.baskets(sales, "transactional", keep_singles=True), sales)
    got = {}
    for r in found.collect():
        got.setdefault(r["job_id"], set()).add(r["mode"])
    for job in ("prod", "word", "lone", "near"):
        mine = sales.where(F.col("job_id") == job).drop("job_id")
        from tillwise.operators import features as D
        one = G.run_rules(D.build_baskets(mine), mine)
        cols = ["antecedents", "consequents", "support", "confidence", "lift", "rank", "mode"]
        assert got[job] == {one.mining_mode}, job
        assert table(found.where(F.col("job_id") == job), cols) == table(one.rules, cols), job
        assert found.where(F.col("job_id") == job).first()["total_found"] == one.total_found
    assert got["prod"] == {"product"} and got["word"] == {"category"} and got["lone"] == {"popular_fallback"}


def test_pruned_baskets_hold_only_items_at_the_support(spark):
    r = random.Random(2)
    base = [("a", sorted({f"i{min(int(r.expovariate(0.15)), 60)}" for _ in range(6)})) for _ in range(400)]
    base += [("b", sorted({f"i{r.randrange(8)}" for _ in range(3)})) for _ in range(30)]
    tx = spark.createDataFrame(base, "job_id string, items array<string>")
    got = J.mine_rules(tx, 0.1, 0.2, 1 << 30, "product")
    for job in ("a", "b"):
        one = G.mine_rules(tx.where(F.col("job_id") == job).drop("job_id"), 0.1, 0.2, 1 << 30)
        cols = ["antecedents", "consequents", "support", "confidence", "lift", "rank"]
        assert table(got.where(F.col("job_id") == job), cols) == table(one.rules, cols)


def test_awkward_jobs(spark):
    schema = "job_id string, customer_id string, transaction_id string, product_name string, quantity double, price double, date timestamp"
    from datetime import datetime
    day = datetime(2024, 1, 1)
    rows = [("j", "c", "t", "p", 1.0, 2.0, day)] * 3 + [(None, "c", "t", "p", 1.0, 2.0, day), ("k", None, "t", "p", 1.0, 2.0, day),
                                                        ("l", "c", "t", "p", 0.0, 2.0, day), ("j", "c", "t2", None, 1.0, None, day)]
    df = spark.createDataFrame(rows, schema)
    kept = J.clean_rows(df, "transactional")
    assert [r["job_id"] for r in kept.collect()] == ["j"] * 3 and kept.columns == df.columns
    assert J.clean_rows(df.where("false"), "transactional").count() == 0
    sold = kept.withColumn("revenue", F.col("quantity") * F.col("price"))
    assert [tuple(r) for r in J.rfm_table(sold, "transactional").collect()] == [("j", "c", 1, 6.0, 1)]
    assert J.robust_scale(J.rfm_table(sold, "transactional")).first()["monetary_scaled"] == 0.0


def test_lines_stay_where_they_are_when_cleaned_by_job(spark, sales):
    """The fences are a small written table: no shuffle of the lines by job, which would put each job into one task."""
    kept = J.clean_rows(sales.withColumn("job_id", F.col("shop")), "transactional")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(job_id" not in plan
    assert kept.count() > 0


def test_only_the_wanted_columns_of_the_lines_are_kept(spark):
    prepare.release()
    some = prepare.raw_sales(spark, SF, columns=("transaction_id",))
    assert set(some.columns) == {"customer_id", "date", "price", "quantity", "transaction_id"}
    whole = prepare.raw_sales(spark, SF)
    assert whole.select(*some.columns).exceptAll(some).isEmpty() and some.count() == whole.count()
    assert prepare.raw_sales(spark, SF, columns=("brand",)) is whole  # a kept table that has them serves
    prepare.release()
