"""Registered queries that give the modelling operators fixed parameters, so that SQL can check them.

F1: one E and M step, and the assignment, of a mixture with given means; F2: its BIC; F4:
the silhouette of the quantile segments; F10: the unit box of two scaled columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import segment as S
from ..operators.silhouette import euclidean_silhouette
from . import prepare
from .q_segment import SEG_CTE
from .registry import register
from .sql import with_sales

# A fixed diagonal mixture over (recency, frequency, monetary), all scaled.
WEIGHTS = [0.5, 0.3, 0.2]
MEANS = [[0.0, 0.0, 0.0], [0.8, -0.9, -0.8], [-0.5, 0.6, 0.7]]
VARIANCES = [[0.6, 0.5, 0.4], [1.2, 0.7, 0.9], [0.3, 0.4, 0.5]]

SCALED = SEG_CTE + """
, xs AS (SELECT f.customer_id, (xr - mr) / CASE WHEN ir = 0 THEN 1 ELSE ir END AS x0,
                (xf - mf) / CASE WHEN i_f = 0 THEN 1 ELSE i_f END AS x1, (xm - mm) / CASE WHEN im = 0 THEN 1 ELSE im END AS x2
         FROM f, q)
"""


def _mixture() -> S.Gmm:
    covs = np.array([np.diag(v) for v in VARIANCES])
    return S.Gmm(0, len(WEIGHTS), "diag", 0, np.array(WEIGHTS), np.array(MEANS), covs)


def _log_density(j: int) -> str:
    terms = " + ".join(f"ln({v}) + (x{i} - ({m})) * (x{i} - ({m})) / {v}"
                       for i, (m, v) in enumerate(zip(MEANS[j], VARIANCES[j], strict=True)))
    return f"ln({WEIGHTS[j]}) - 0.5 * (3 * ln(2 * pi()) + {terms})"


DENSITY = SCALED + f"""
, lp AS (SELECT xs.*, unnest(generate_series(0, {len(WEIGHTS) - 1})) AS comp FROM xs),
ld AS (SELECT *, CASE comp {' '.join(f'WHEN {j} THEN {_log_density(j)}' for j in range(len(WEIGHTS)))} END AS l FROM lp),
ll AS (SELECT customer_id, max(l) AS top, ln(sum(exp(l - tp))) + max(l) AS total
       FROM (SELECT *, max(l) OVER (PARTITION BY customer_id) AS tp FROM ld) GROUP BY customer_id)
"""


@register("gmm_em_step", with_sales(DENSITY + """
, rs AS (SELECT ld.*, exp(l - total) AS r FROM ld JOIN ll USING (customer_id)),
sm AS (SELECT comp, sum(r) AS sw, sum(r * x0) / sum(r) AS m0, sum(r * x1) / sum(r) AS m1, sum(r * x2) / sum(r) AS m2,
              sum(r * x0 * x0) / sum(r) AS q0, sum(r * x1 * x1) / sum(r) AS q1, sum(r * x2 * x2) / sum(r) AS q2
       FROM rs GROUP BY comp),
tt AS (SELECT sum(total) AS l, count(*) AS n FROM ll)
SELECT comp::BIGINT AS component, round(sw / sum(sw) OVER (), 6) AS weight, round(m0, 6) + 0.0 AS mean_recency,
       round(m1, 6) + 0.0 AS mean_frequency, round(m2, 6) + 0.0 AS mean_monetary,
       round(greatest(q0 - m0 * m0 + 1e-6, 1e-6), 6) AS var_recency, round(greatest(q1 - m1 * m1 + 1e-6, 1e-6), 6) AS var_frequency,
       round(greatest(q2 - m2 * m2 + 1e-6, 1e-6), 6) AS var_monetary, round(l / n, 6) AS mean_log_likelihood,
       round((-2 * l + (3 * 3 + 2 + 3 * 3) * ln(n)) / n, 6) AS bic_per_customer
FROM sm, tt
"""))
def gmm_em_step(spark, sf_dir):
    """F1 + F2: one distributed E step, the M step from its sums, log-likelihood and BIC of a given mixture."""
    rfm = prepare.customer_rfm(spark, sf_dir)
    n = rfm.select(*S.FEATURES).na.drop().count()
    g = _mixture()
    stats = S._pass(rfm.select(*S.FEATURES).na.drop(), [g])[0]
    bic = S.bic(stats["ll"], g.k, g.cov, n)
    S._mstep(g, stats["comps"], n)
    rows = [(j, float(g.weights[j]), *[float(x) for x in g.means[j]], *[float(g.covs[j][i][i]) for i in range(3)],
             stats["ll"] / n, bic / n) for j in range(g.k)]
    names = ["weight", *[f"{k}_{c}" for k in ("mean", "var") for c in ("recency", "frequency", "monetary")],
             "mean_log_likelihood", "bic_per_customer"]
    df = spark.createDataFrame(rows, "component bigint, " + ", ".join(f"{c} double" for c in names))
    return df.select("component", *[(F.round(c, 6) + 0.0).alias(c) for c in names])


@register("gmm_assign", with_sales(DENSITY + """
SELECT customer_id, arg_max(comp, l)::BIGINT AS component FROM ld GROUP BY customer_id
"""))
def gmm_assign(spark, sf_dir):
    """each customer's most responsible component of a given mixture."""
    return S.assign_components(prepare.customer_rfm(spark, sf_dir).select("customer_id", *S.FEATURES).na.drop(), _mixture()) \
            .select("customer_id", "component")


#: Mean squared distance to a cluster from its sums: |x|² + E|y|² − 2 x·E[y].
SILHOUETTE = SCALED + """
, xl AS (SELECT xs.*, cluster, x0 * x0 + x1 * x1 + x2 * x2 AS ss FROM xs JOIN seg USING (customer_id)),
cs AS (SELECT cluster, count(*) AS n, avg(x0) AS c0, avg(x1) AS c1, avg(x2) AS c2, avg(ss) AS cc FROM xl GROUP BY 1),
ds AS (SELECT customer_id, xl.cluster AS own, cs.cluster, n, ss + cc - 2 * (x0 * c0 + x1 * c1 + x2 * c2) AS d FROM xl, cs),
ab AS (SELECT customer_id, max(CASE WHEN own = cluster THEN n END) AS n,
              max(CASE WHEN own = cluster THEN d * n / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> cluster THEN d END) AS b
       FROM ds GROUP BY customer_id),
sil AS (SELECT avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS score FROM ab)
"""


@register("segment_silhouette", with_sales(SILHOUETTE + "SELECT round(score, 6) AS silhouette_sq_euclidean FROM sil"))
def segment_silhouette(spark, sf_dir):
    """squared-Euclidean silhouette of the quantile segments."""
    lab, _ = prepare.quantile_segments(spark, sf_dir, 4)
    return spark.createDataFrame([(round(S.silhouette_sq_euclidean(lab), 6),)], "silhouette_sq_euclidean double")


@register("segment_silhouette_euclidean", with_sales(SCALED + """
, xl AS (SELECT xs.*, cluster FROM xs JOIN seg USING (customer_id)),
dd AS (SELECT a.customer_id, a.cluster AS own, b.cluster,
              sum(sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))) AS d, count(*) AS n
       FROM xl a, xl b GROUP BY 1, 2, 3),
ab AS (SELECT customer_id, max(CASE WHEN own = cluster THEN n END) AS n, max(CASE WHEN own = cluster THEN d / greatest(n - 1, 1) END) AS a,
              min(CASE WHEN own <> cluster THEN d / n END) AS b FROM dd GROUP BY 1)
SELECT round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM ab
"""))
def segment_silhouette_euclidean(spark, sf_dir):
    """plain-Euclidean silhouette of the quantile segments to 4 decimals."""
    lab, _ = prepare.quantile_segments(spark, sf_dir, 4)
    return spark.createDataFrame([(round(euclidean_silhouette(lab), 4),)], "silhouette double")


@register("map_scaled_rfm", with_sales(SCALED + """
, bx AS (SELECT min(x0) AS a, max(x0) AS b, min(x2) AS c, max(x2) AS d FROM xs)
SELECT customer_id, round((x0 - a) / CASE WHEN b = a THEN 1 ELSE b - a END, 6) AS sx,
       round((x2 - c) / CASE WHEN d = c THEN 1 ELSE d - c END, 6) AS sy FROM xs, bx
"""))
def map_scaled_rfm(spark, sf_dir):
    """recency and monetary of every customer in the unit box."""
    pts = prepare.customer_rfm(spark, sf_dir).select("customer_id", F.col("recency_scaled").alias("x"),
                                                     F.col("monetary_scaled").alias("y"))
    return S.map_scaled(pts).select("customer_id", F.round("sx", 6).alias("sx"), F.round("sy", 6).alias("sy"))


@register("map_centroids_rfm", with_sales(SCALED + """
SELECT label, round(avg(x0), 6) + 0.0 AS cx, round(avg(x2), 6) + 0.0 AS cy, count(*) AS points
FROM xs JOIN seg USING (customer_id) GROUP BY label
"""))
def map_centroids_rfm(spark, sf_dir):
    """mean position per segment label over recency and monetary."""
    lab, _ = prepare.quantile_segments(spark, sf_dir, 4)
    pts = lab.select("label", F.col("recency_scaled").alias("x"), F.col("monetary_scaled").alias("y"))
    return S.map_centroids(pts).select("label", (F.round("cx", 6) + 0.0).alias("cx"), (F.round("cy", 6) + 0.0).alias("cy"), "points")
