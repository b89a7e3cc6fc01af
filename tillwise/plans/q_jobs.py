"""Registered queries for K1 over many jobs: the clean sales with the customer's region as the job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import by_job as J
from ..operators import features as D
from ..operators import report as K
from ..operators import rules as G
from ..operators import segment as S
from ..sources.tables import SALES_SQL
from . import prepare
from .registry import register

# Clean sales per job: the fences are those of the job's own prices.
JOB_SALES = f"""
WITH raw AS (SELECT region AS job_id, * FROM ({SALES_SQL})),
pos AS (SELECT * FROM raw WHERE customer_id IS NOT NULL AND date IS NOT NULL AND price IS NOT NULL AND quantity IS NOT NULL
          AND quantity > 0 AND price > 0 AND job_id IS NOT NULL),
fence AS (SELECT job_id, q1, q3, q1 - 3 * (q3 - q1) AS low, q3 + 3 * (q3 - q1) AS high
          FROM (SELECT job_id, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM pos GROUP BY 1)),
sales AS (SELECT pos.*, quantity * price AS revenue FROM pos JOIN fence USING (job_id) WHERE price BETWEEN low AND high)
"""

JOB_RFM = JOB_SALES + """
, cust AS (SELECT job_id, customer_id, count(DISTINCT transaction_id) AS frequency, sum(revenue) AS monetary, max(date) AS last
           FROM sales GROUP BY 1, 2),
until AS (SELECT job_id, max(date) + INTERVAL 1 DAY AS until FROM sales GROUP BY 1),
rfm AS (SELECT job_id, customer_id, frequency, monetary, date_diff('day', last, until) AS recency FROM cust JOIN until USING (job_id)),
lg AS (SELECT *, recency::DOUBLE AS r, ln(1 + frequency) AS f, ln(1 + monetary) AS m FROM rfm),
q AS (SELECT job_id, quantile_cont(r, [0.25, 0.5, 0.75]) AS qr, quantile_cont(f, [0.25, 0.5, 0.75]) AS qf,
             quantile_cont(m, [0.25, 0.5, 0.75]) AS qm FROM lg GROUP BY 1),
scaled AS (SELECT job_id, customer_id, frequency, monetary, recency,
  (r - qr[2]) / CASE WHEN qr[3] = qr[1] THEN 1 ELSE qr[3] - qr[1] END AS recency_scaled,
  (f - qf[2]) / CASE WHEN qf[3] = qf[1] THEN 1 ELSE qf[3] - qf[1] END AS frequency_scaled,
  (m - qm[2]) / CASE WHEN qm[3] = qm[1] THEN 1 ELSE qm[3] - qm[1] END AS monetary_scaled
  FROM lg JOIN q USING (job_id))
"""


def _raw(spark, sf_dir, *columns):
    """Sales lines with their job; of the columns beside those of cleaning and of customers only the given ones."""
    raw = prepare.raw_sales(spark, sf_dir, columns=("transaction_id", "region", *columns))
    return raw.withColumn(J.JOB, F.col("region"))


def clean(spark, sf_dir, *columns):
    """C2–C4 and D1 per job: filters over the kept lines, whose fences are kept for the session."""
    key = prepare._key(spark, sf_dir, "job_fences")
    raw = _raw(spark, sf_dir, *columns)
    if key not in prepare._CACHE:
        prepare._CACHE[key] = J.fences(J.before_fences(raw, "transactional"))
    return D.engineer_features(J.clean_rows(raw, "transactional", cut=prepare._CACHE[key]), "transactional")


def customers(spark, sf_dir, *columns):
    key = prepare._key(spark, sf_dir, "job_rfm")
    if key not in prepare._CACHE:
        rfm = prepare.materialize(J.rfm_table(clean(spark, sf_dir, *columns), "transactional"), "job_rfm", key)
        prepare._CACHE[prepare._key(spark, sf_dir, "job_rfm_raw")] = rfm  # release() frees the table below the projection too
        prepare._CACHE[key] = J.robust_scale(rfm)
    return prepare._CACHE[key]


@register("job_fences", JOB_SALES + """
SELECT job_id, round(q1, 4) AS q1, round(q3, 4) AS q3, round(low, 4) AS low, round(high, 4) AS high,
       (SELECT count(*) FROM pos p WHERE p.job_id = fence.job_id) AS rows_in,
       (SELECT count(*) FROM sales s WHERE s.job_id = fence.job_id) AS rows_kept FROM fence
""")
def job_fences(spark, sf_dir):
    """C4 per job: exact quartile fences and the rows within them."""
    pos = J.before_fences(_raw(spark, sf_dir), "transactional")
    counts = pos.groupBy(J.JOB).agg(F.count("*").alias("rows_in")).join(clean(spark, sf_dir).groupBy(J.JOB).agg(F.count("*").alias("rows_kept")), J.JOB)
    return J.fences(pos).join(counts, J.JOB).select(J.JOB, *[F.round(c, 4).alias(c) for c in ("q1", "q3", "low", "high")], "rows_in", "rows_kept")


@register("job_rfm", JOB_RFM + """
SELECT job_id, customer_id, frequency, round(monetary, 4) AS monetary, recency, round(recency_scaled, 6) AS recency_scaled,
       round(frequency_scaled, 6) AS frequency_scaled, round(monetary_scaled, 6) AS monetary_scaled FROM scaled
""")
def job_rfm(spark, sf_dir):
    """D4 + D6 per job: every customer against its own job's last day and quartiles."""
    return customers(spark, sf_dir).select(J.JOB, "customer_id", "frequency", F.round("monetary", 4).alias("monetary"), "recency",
                                           *[F.round(c, 6).alias(c) for c in S.FEATURES])


_LABELS = ", ".join(f"'{x}'" for x in S.SEGMENT_LABELS)


@register("job_segments", JOB_RFM + f"""
, sc AS (SELECT *, round(monetary_scaled + frequency_scaled - recency_scaled, 9) AS score FROM scaled),
cut AS (SELECT job_id, quantile_cont(score, [0.25, 0.5, 0.75]) AS c FROM sc GROUP BY 1),
comp AS (SELECT sc.*, (score > c[1])::INT + (score > c[2])::INT + (score > c[3])::INT AS component FROM sc JOIN cut USING (job_id)),
rn AS (SELECT job_id, component, row_number() OVER (PARTITION BY job_id ORDER BY avg(monetary) DESC, component) - 1 AS cluster
       FROM comp GROUP BY 1, 2),
g AS (SELECT job_id, cluster, count(*) AS size, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m
      FROM comp JOIN rn USING (job_id, component) GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN max(m) OVER w > min(m) OVER w THEN (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) ELSE 0.5 END
        + CASE WHEN max(f) OVER w > min(f) OVER w THEN (f - min(f) OVER w) / (max(f) OVER w - min(f) OVER w) ELSE 0.5 END
        - CASE WHEN max(r) OVER w > min(r) OVER w THEN (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) ELSE 0.5 END AS score,
      sum(size) OVER w AS total FROM g WINDOW w AS (PARTITION BY job_id))
SELECT job_id, cluster AS cluster_id, [{_LABELS}][row_number() OVER (PARTITION BY job_id ORDER BY score DESC, cluster)] AS label, size,
       round(size / total * 100, 1) AS pct_of_customers, round(r, 1) AS avg_recency_days, round(f, 1) AS avg_frequency,
       round(m + 1e-6, 2) AS avg_monetary FROM n
""")
def job_segments(spark, sf_dir):
    """F12 + F3 + F6 + F7 per job: segment profiles from each job's own quantiles."""
    lab, prof = J.quantile_segments(customers(spark, sf_dir))
    # the mean of two amounts in cents may lie half way, where the order of a sum would decide: just above it, it does not
    means = lab.groupBy(J.JOB, F.col("cluster").alias("cluster_id")).agg(F.round(F.avg("monetary") + 1e-6, 2).alias("avg_monetary"))
    return prof.drop("avg_monetary").join(means, [J.JOB, "cluster_id"])


@register("job_regions", JOB_SALES.replace("region AS job_id", "brand AS job_id") + """
, g AS (SELECT job_id, region, round(sum(revenue), 2) AS total_revenue,
               count(DISTINCT customer_id) AS unique_customers, count(*) AS total_transactions FROM sales GROUP BY 1, 2),
s AS (SELECT *, round(total_revenue / sum(total_revenue) OVER (PARTITION BY job_id) * 100, 1) AS revenue_share_pct FROM g)
SELECT job_id, upper(region) AS region, total_revenue, unique_customers, total_transactions, revenue_share_pct,
       row_number() OVER w AS rank, round(sum(revenue_share_pct) OVER w, 1) AS cumulative_share_pct
FROM s WINDOW w AS (PARTITION BY job_id ORDER BY total_revenue DESC, region)
""")
def job_regions(spark, sf_dir):
    """H3 + H4 per job, with the brand as the job: regions by revenue with shares and running shares."""
    from ..operators import geo as H
    brand = J.clean_rows(prepare.raw_sales(spark, sf_dir, columns=("brand", "region")).withColumn(J.JOB, F.col("brand")), "transactional")
    stats = J.region_stats(H.clean_geo(D.engineer_features(brand, "transactional")))
    return stats.withColumn("region", F.upper("region")).drop("avg_order_value")


@register("job_rules", JOB_SALES + f"""
, lines AS (SELECT DISTINCT job_id, customer_id, transaction_id, brand FROM sales WHERE brand IS NOT NULL),
tx AS (SELECT job_id, customer_id, transaction_id FROM lines GROUP BY 1, 2, 3 HAVING count(*) > 1),
n AS (SELECT job_id, count(*) AS n FROM tx GROUP BY 1 HAVING count(*) >= {G.MIN_BASKETS}),
it AS (SELECT * FROM lines JOIN tx USING (job_id, customer_id, transaction_id) JOIN n USING (job_id)),
one AS (SELECT job_id, brand, count(*) / any_value(n) AS s FROM it GROUP BY 1, 2),
lv AS (SELECT job_id, CASE WHEN max(s) >= 0.02 THEN 0.02 WHEN max(s) >= 0.01 THEN 0.01 WHEN max(s) >= 0.005 THEN 0.005 END AS l FROM one GROUP BY 1),
two AS (SELECT a.job_id, a.brand AS a, b.brand AS c, count(*) / any_value(a.n) AS s FROM it a
        JOIN it b USING (job_id, customer_id, transaction_id) WHERE a.brand <> b.brand GROUP BY 1, 2, 3),
r AS (SELECT two.job_id, two.a, two.c, two.s AS support, two.s / x.s AS confidence, two.s / x.s / y.s AS lift
      FROM two JOIN lv USING (job_id) JOIN one x ON x.job_id = two.job_id AND x.brand = two.a
      JOIN one y ON y.job_id = two.job_id AND y.brand = two.c WHERE two.s >= l),
cl AS (SELECT job_id, CASE WHEN max(confidence) >= 0.2 THEN 0.2 WHEN max(confidence) >= 0.1 THEN 0.1 END AS c0 FROM r GROUP BY 1)
SELECT job_id, a AS antecedent, c AS consequent, round(support, 4) AS support, round(confidence, 4) AS confidence, round(lift, 4) AS lift
FROM r JOIN cl USING (job_id) WHERE confidence >= c0
""")
def job_rules(spark, sf_dir):
    """G2–G5 per job: brand rules of two items, each job with its own relaxed support and confidence."""
    tx = J.baskets(clean(spark, sf_dir, "brand"), "transactional", label="brand")
    rules = J.mine_rules(tx, 0.02, 0.2, 1 << 30, "product").where((F.size("antecedents") == 1) & (F.size("consequents") == 1))
    return rules.select(J.JOB, F.col("antecedents")[0].alias("antecedent"), F.col("consequents")[0].alias("consequent"),
                        "support", "confidence", "lift")


@register("job_report_overview", JOB_SALES + """
, s AS (SELECT job_id, count(DISTINCT customer_id) AS c, count(DISTINCT transaction_id) AS t, round(sum(revenue), 2) AS r,
               round(avg(revenue), 2) AS a, strftime(min(date), '%Y-%m-%d') AS d0, strftime(max(date), '%Y-%m-%d') AS d1 FROM sales GROUP BY 1),
m AS (SELECT job_id, strftime(date, '%Y-%m') AS month, round(sum(revenue), 2) AS v FROM sales GROUP BY 1, 2),
l AS (SELECT *, lag(v) OVER (PARTITION BY job_id ORDER BY month) AS p FROM m),
g AS (SELECT job_id, arg_max(CASE WHEN p > 0 THEN round((v - p) / p * 100, 1) ELSE 0.0 END, month) AS g FROM l GROUP BY 1)
SELECT job_id, concat_ws(chr(10), '## Dataset Overview', '- Total customers: ' || c, '- Total transactions: ' || t,
         '- Total revenue: $' || format('{:,.2f}', r), '- Average order value: $' || format('{:,.2f}', a),
         '- Date range: ' || d0 || ' to ' || d1) AS overview,
       '- Month-over-month growth (latest): ' || printf('%+.1f', g + 0.0) || '%' AS growth
FROM s JOIN g USING (job_id)
""")
def job_report_overview(spark, sf_dir):
    """K1 for every job in one run: overview and latest growth as the reports state them."""
    more = ("product_id", "product_name")
    sales, raw = clean(spark, sf_dir, *more), _raw(spark, sf_dir, *more)
    lab, prof = J.quantile_segments(customers(spark, sf_dir, *more))
    summary = J.summary(sales, raw)
    none = spark.createDataFrame([], "job_id string, antecedents array<string>, consequents array<string>, confidence double, lift double, rank int")
    report = K.build_report(summary, prof, none, J.monthly_revenue(sales), J.top_products(sales), J.silhouette(lab),
                            summary.select(J.JOB, F.lit("general").alias("focus")))
    parts = F.split("report", "\n\n")
    return report.select(J.JOB, F.filter(parts, lambda x: F.startswith(x, F.lit("## Dataset")))[0].alias("overview"),
                         F.regexp_extract("report", "(- Month-over-month growth [^\n]*)", 1).alias("growth"))
