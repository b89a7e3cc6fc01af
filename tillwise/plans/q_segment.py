"""Registered queries for sections F (segments) and J (scenarios).

The SQL-checkable chain uses the deterministic quantile segments (F12) as the
cluster column; the mixture sweep (F1/F2), silhouette (F4) and map (F8–F10)
are property checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as I
from ..operators import geo as H
from ..operators import scenario as J
from ..operators import segment as S
from ..operators import stats as E
from . import prepare
from .q_forecast import LINEAR_SQL
from .q_geo import GEO
from .registry import register
from .sql import with_sales

_LABELS = "[" + ", ".join(f"'{x}'" for x in S.SEGMENT_LABELS) + "]"

SEG_CTE = """
, snap AS (SELECT max(date) + INTERVAL 1 DAY AS snapshot FROM sales),
r AS (SELECT customer_id, count(DISTINCT transaction_id) AS frequency, sum(revenue) AS monetary,
             floor((epoch_us((SELECT snapshot FROM snap)) - epoch_us(max(date))) / 86400000000) AS recency
      FROM sales GROUP BY customer_id),
f AS (SELECT customer_id, CAST(recency AS DOUBLE) AS xr, ln(1 + greatest(frequency, 0)) AS xf,
             ln(1 + greatest(monetary, 0)) AS xm FROM r),
q AS (SELECT quantile_cont(xr, 0.5) AS mr, quantile_cont(xr, 0.75) - quantile_cont(xr, 0.25) AS ir,
             quantile_cont(xf, 0.5) AS mf, quantile_cont(xf, 0.75) - quantile_cont(xf, 0.25) AS i_f,
             quantile_cont(xm, 0.5) AS mm, quantile_cont(xm, 0.75) - quantile_cont(xm, 0.25) AS im FROM f),
sc AS (SELECT r.customer_id, r.frequency, r.monetary, r.recency,
              round((xm - mm) / CASE WHEN im = 0 THEN 1 ELSE im END
                    + (xf - mf) / CASE WHEN i_f = 0 THEN 1 ELSE i_f END
                    - (xr - mr) / CASE WHEN ir = 0 THEN 1 ELSE ir END, 9) AS score
       FROM r JOIN f USING (customer_id), q),
t AS (SELECT quantile_cont(score, 0.25) AS t1, quantile_cont(score, 0.5) AS t2,
             quantile_cont(score, 0.75) AS t3 FROM sc),
comp AS (SELECT sc.*, CAST(score > t1 AS INT) + CAST(score > t2 AS INT) + CAST(score > t3 AS INT) AS component
         FROM sc, t),
cm AS (SELECT component, avg(monetary) AS m FROM comp GROUP BY 1),
rn AS (SELECT component, row_number() OVER (ORDER BY m DESC, component) - 1 AS cluster FROM cm),
lab AS (SELECT comp.*, rn.cluster FROM comp JOIN rn USING (component)),
cg AS (SELECT cluster, count(*) AS size, avg(recency) AS r_mean, avg(frequency) AS f_mean,
              avg(monetary) AS m_mean FROM lab GROUP BY 1),
nrm AS (SELECT cg.*,
          CASE WHEN max(m_mean) OVER () > min(m_mean) OVER ()
               THEN (m_mean - min(m_mean) OVER ()) / (max(m_mean) OVER () - min(m_mean) OVER ()) ELSE 0.5 END
        + CASE WHEN max(f_mean) OVER () > min(f_mean) OVER ()
               THEN (f_mean - min(f_mean) OVER ()) / (max(f_mean) OVER () - min(f_mean) OVER ()) ELSE 0.5 END
        - CASE WHEN max(r_mean) OVER () > min(r_mean) OVER ()
               THEN (r_mean - min(r_mean) OVER ()) / (max(r_mean) OVER () - min(r_mean) OVER ()) ELSE 0.5 END
          AS score FROM cg),
prof AS (SELECT cluster AS cluster_id,
                LABELS[least(row_number() OVER (ORDER BY score DESC, cluster), 8)] AS label,
                CAST(size AS BIGINT) AS size, round(size / sum(size) OVER () * 100, 1) AS pct_of_customers,
                round(r_mean, 1) AS avg_recency_days, round(f_mean, 1) AS avg_frequency,
                round(m_mean, 2) AS avg_monetary FROM nrm),
seg AS (SELECT lab.customer_id, lab.cluster, prof.label FROM lab JOIN prof ON prof.cluster_id = lab.cluster)
""".replace("LABELS", _LABELS)


def _rfm(spark, sf_dir):
    return prepare.customer_rfm(spark, sf_dir)


def _quantile_segments(spark, sf_dir):
    return prepare.quantile_segments(spark, sf_dir, 4)


@register("segments_quantile", with_sales(SEG_CTE + "SELECT customer_id, cluster, label FROM seg"))
def segments_quantile(spark, sf_dir):
    """F12 + F3: each customer's quantile segment, renumbered by mean spend, with its label."""
    lab, _ = _quantile_segments(spark, sf_dir)
    return lab.select("customer_id", "cluster", "label")


@register("segment_profiles", with_sales(SEG_CTE + "SELECT * FROM prof"))
def segment_profiles(spark, sf_dir):
    """F6 + F7 over the quantile segments."""
    _, prof = _quantile_segments(spark, sf_dir)
    return prof


@register("segment_comparison", with_sales(SEG_CTE + """
SELECT cluster_id, label,
       round(avg_monetary / greatest(max(avg_monetary) OVER (), 1.0) * 100, 1) AS avg_monetary_pct,
       round(avg_frequency / greatest(max(avg_frequency) OVER (), 1.0) * 100, 1) AS avg_frequency_pct,
       round(avg_recency_days / greatest(max(avg_recency_days) OVER (), 1.0) * 100, 1) AS avg_recency_days_pct
FROM prof
"""))
def segment_comparison(spark, sf_dir):
    """F11."""
    _, prof = _quantile_segments(spark, sf_dir)
    return S.segment_comparison(prof)


@register("geo_segments_per_region", with_sales(SEG_CTE + GEO + """
SELECT homes.region, seg.label, CAST(count(*) AS BIGINT) AS customers
FROM homes JOIN seg USING (customer_id) GROUP BY 1, 2
"""))
def geo_segments_per_region(spark, sf_dir):
    """H9: customers per (home region, segment)."""
    lab, _ = _quantile_segments(spark, sf_dir)
    geo = H.clean_geo(prepare.clean_sales(spark, sf_dir), "region")
    return H.segments_per_region(geo, lab)


_EL = """
, el AS (SELECT label, size, avg_monetary,
                floor((-0.6 - 1.4 * greatest(0.0, least(1.0, 1 - (CASE WHEN avg(avg_monetary) OVER () > 0
                        THEN avg_monetary / avg(avg_monetary) OVER () ELSE 1.0 END - 0.5)))) * 100 + 0.5) / 100
                  AS elasticity
         FROM prof)
"""


@register("segment_elasticity", with_sales(SEG_CTE + _EL + "SELECT label, size, avg_monetary, elasticity FROM el"))
def segment_elasticity(spark, sf_dir):
    """J1."""
    _, prof = _quantile_segments(spark, sf_dir)
    return J.segment_elasticity(prof)


ALL_INP = ", inp AS (SELECT 'all' AS series_key, date AS ts, revenue AS value FROM sales)"

_DISC = "[" + ", ".join(str(d) for d in J.DISCOUNTS) + "]"
_HZ = "[" + ", ".join(str(h) for h in J.HORIZONS) + "]"

_SCEN = """
, tg AS (SELECT label AS target, size AS target_customers, size / greatest(sum(size) OVER (), 1) AS target_pct,
                elasticity FROM el
         UNION ALL SELECT 'all', sum(size), 1.0, -1.2 FROM prof),
grid AS (SELECT tg.*, d.discount_pct, h.horizon FROM tg, (SELECT unnest(DISC) AS discount_pct) d,
                (SELECT unnest(HZ) AS horizon) h),
aov AS (SELECT round(avg(revenue), 2) AS aov FROM sales),
days AS (SELECT grid.*, lin.step, lin.predicted AS value,
                (1 - discount_pct / 100.0) * (1 + abs(elasticity) * discount_pct / 100.0) AS multi
         FROM grid JOIN lin ON lin.step <= grid.horizon),
days2 AS (SELECT days.*, value * target_pct * multi + value * (1 - target_pct) AS sim,
                 floor(target_customers * (SELECT aov FROM aov) * discount_pct / 100.0 * 0.35 + 0.5) AS discount_cost
          FROM days),
days3 AS (SELECT days2.*, sum(value) OVER w AS cum_base, sum(sim) OVER w AS cum_sim FROM days2
          WINDOW w AS (PARTITION BY target, discount_pct, horizon ORDER BY step
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
agg AS (SELECT target, discount_pct, horizon, sum(value) AS b, sum(sim) AS s, any_value(target_customers) AS tc,
               any_value(elasticity) AS e, any_value(discount_cost) AS cost,
               min(CASE WHEN cum_sim - cum_base >= discount_cost THEN step END) AS be
        FROM days3 GROUP BY 1, 2, 3)
SELECT target, CAST(discount_pct AS BIGINT) AS discount_pct, CAST(horizon AS BIGINT) AS horizon,
       floor(b + 0.5) AS base_total, floor(s + 0.5) AS sim_total,
       floor(CASE WHEN b > 0 THEN (s - b) / b * 100 ELSE 0.0 END * 10 + 0.5) / 10 AS lift_pct,
       cost AS discount_cost,
       floor(CASE WHEN cost > 0 THEN (s - b - cost) / cost * 100 ELSE 0.0 END + 0.5) AS roi_pct,
       CAST(tc AS BIGINT) AS target_customers, e AS elasticity,
       floor(abs(e) * discount_pct / 100.0 * 100 + 0.5) AS vol_uplift_pct, CAST(be AS BIGINT) AS break_even_day
FROM agg
""".replace("DISC", _DISC).replace("HZ", _HZ)


def _baseline(spark, sf_dir):
    fc = I.linear_forecast(I.daily_series(I.resolve_input(prepare.clean_sales(spark, sf_dir))))
    return J.baseline_points(fc, None)


@register("scenario_totals", with_sales(SEG_CTE + ALL_INP + LINEAR_SQL + _EL + _SCEN))
def scenario_totals(spark, sf_dir):
    """Every (target, discount, horizon) scenario over the linear baseline."""
    _, prof = _quantile_segments(spark, sf_dir)
    s = prepare.clean_sales(spark, sf_dir)
    aov = E.dataset_summary(s).select("avg_order_value").scalar()
    return J.scenario_totals(prof, _baseline(spark, sf_dir), aov)


@register("scenario_segment_impact", with_sales(SEG_CTE + ALL_INP + LINEAR_SQL + _EL + """
, cum AS (SELECT step, sum(predicted) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
          FROM lin),
hz AS (SELECT step AS horizon, c FROM cum WHERE step IN (SELECT unnest(HZ))),
sg AS (SELECT label, elasticity, CASE WHEN sum(size) OVER () > 0 THEN size / sum(size) OVER () ELSE 0.0 END AS pct
       FROM el),
tg AS (SELECT label AS target FROM el UNION ALL SELECT 'all'),
grid AS (SELECT tg.target, d.discount_pct, hz.horizon, hz.c FROM tg, (SELECT unnest(DISC) AS discount_pct) d, hz)
SELECT grid.target, CAST(discount_pct AS BIGINT) AS discount_pct, CAST(horizon AS BIGINT) AS horizon,
       sg.label AS segment, floor(c * pct + 0.5) AS base,
       floor(CASE WHEN grid.target = 'all' OR grid.target = sg.label
                  THEN c * pct * (1 - discount_pct / 100.0) * (1 + abs(sg.elasticity) * discount_pct / 100.0)
                  ELSE c * pct END + 0.5) AS sim,
       grid.target = 'all' OR grid.target = sg.label AS targeted
FROM grid, sg
""".replace("DISC", _DISC).replace("HZ", _HZ)))
def scenario_segment_impact(spark, sf_dir):
    """J6."""
    _, prof = _quantile_segments(spark, sf_dir)
    return J.segment_impact(prof, _baseline(spark, sf_dir))


_SWEEPS: dict[tuple, S.SweepResult] = {}  # parameters of the fitted mixtures, some kilobytes per table


def _sweep(spark, sf_dir) -> S.SweepResult:
    key = prepare._key(spark, sf_dir, "gmm_sweep")
    if key not in _SWEEPS:
        _SWEEPS[key] = S.gmm_sweep(_rfm(spark, sf_dir))
    return _SWEEPS[key]


@register("gmm_sweep")
def gmm_sweep(spark, sf_dir):
    """F1 + F2: every (k, covariance, start) mixture with log-likelihood and BIC; the chosen one flagged."""
    return spark.createDataFrame(_sweep(spark, sf_dir).table)


@register("gmm_segment_profiles")
def gmm_segment_profiles(spark, sf_dir):
    """F1 → F3 → F6/F7: profiles of the BIC-chosen mixture, with silhouette."""
    lab, prof, res = S.segment_by_mixture(_rfm(spark, sf_dir), _sweep(spark, sf_dir))
    lab = lab.persist()
    sil = S.silhouette_sq_euclidean(lab)
    lab.unpersist()
    return prof.withColumn("k_fitted", F.lit(res.best.k)).withColumn("covariance", F.lit(res.best.cov)) \
               .withColumn("silhouette_sq_euclidean", F.lit(round(sil, 4)))


@register("customer_map")
def customer_map(spark, sf_dir):
    """F8 + F10: PCA map of every customer of the quantile segments, scaled to the unit box."""
    lab, _ = _quantile_segments(spark, sf_dir)
    return S.map_scaled(S.customer_map(lab))


@register("customer_map_centroids")
def customer_map_centroids(spark, sf_dir):
    """mean map position per segment label."""
    lab, _ = _quantile_segments(spark, sf_dir)
    return S.map_centroids(S.customer_map(lab))
