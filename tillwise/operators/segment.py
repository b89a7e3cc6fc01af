"""F: customer segmentation — Gaussian-mixture sweep by BIC, renumbering,
profiles, rank labels, silhouette, 2-D map, segment comparison, and a
deterministic quantile segmentation.

The mixture sweep (F1/F2) is distributed EM over the customer table:
* every (k, covariance type, start) model that is still improving lives in a
  small parameter list shipped with the task closure (≤ 105 models × k × 3);
* starts come from k-means over every customer (k-means|| and Lloyd passes, each
  one distributed pass for all k and starts);
* one ``mapInPandas`` pass per EM step computes, per customer partition, the
  responsibilities of every live model and emits, once per partition, only
  per-(model, component) sufficient statistics (Σr, Σr·x, Σr·x·xᵀ) and the
  log-likelihood;
* a Spark aggregate sums them; the driver turns the sums into new parameters.
Converged models drop out, so later passes get cheaper. Nothing per customer
ever reaches the driver. Random starts cannot reproduce the reference's
library starts, so labels are checked by properties (log-likelihood never
falls, BIC choice is the minimum, one segment per customer).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import PySparkNotImplementedError
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantile import exact_quantiles

# ── Fixed values (must equal the reference's) ───────────────────────────────
# Segment names, best composite score first.
SEGMENT_LABELS = ["Champions", "Loyal Customers", "Potential Loyalists", "New Customers", "Promising",
                  "At Risk", "Hibernating", "Lost Customers"]
COV_TYPES = ["full", "tied", "diag"]
N_INIT = 5
MAX_ITER = 300
TOL = 1e-3
REG_COVAR = 1e-6
MIN_CUSTOMERS = 10
MAX_K = 8
# ─────────────────────────────────────────────────────────────────────────────

FEATURES = ["recency_scaled", "frequency_scaled", "monetary_scaled"]
EM_ROWS_PER_TASK = 200_000
EM_BATCH = 8192
_LOG2PI = math.log(2 * math.pi)


def max_components(n: int) -> int:
    return max(2, min(MAX_K, n // 5))


# ── F1 / F2: distributed EM ──────────────────────────────────────────────────

@dataclass
class Gmm:
    model_id: int
    k: int
    cov: str
    start: int
    weights: np.ndarray
    means: np.ndarray            # (k, 3)
    covs: np.ndarray             # (k, 3, 3) — tied/diag stored expanded
    lower_bound: float = -np.inf
    n_iter: int = 0
    converged: bool = False
    history: list = field(default_factory=list)


# A row's terms 1, x, x² and x_a·x_b: a log density is linear in them, and their
# weighted sums are the sufficient statistics.
_SQUARES = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
_TERMS = 1 + 3 + len(_SQUARES)


def _terms(X: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(X)), X, *[X[:, a] * X[:, b] for a, b in _SQUARES]])


def _density(weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """(terms, k): coefficients of log(w_j · N(x | μ_j, Σ_j)) on a row's terms."""
    prec = np.linalg.inv(covs)
    lin = np.einsum("kab,kb->ka", prec, means)
    const = np.log(weights) - 0.5 * (3 * _LOG2PI + np.linalg.slogdet(covs)[1] + np.einsum("ka,ka->k", lin, means))
    quad = np.array([-0.5 * prec[:, a, b] * (1 if a == b else 2) for a, b in _SQUARES])
    return np.vstack([const, lin.T, quad])


_STATS = [f"t{i}" for i in range(_TERMS)]
_STATS_SCHEMA = "model_id int, comp int, " + ", ".join(f"{c} double" for c in _STATS) + ", ll double"


def _mstep(g: Gmm, stats: dict[int, tuple], n: int) -> None:
    k = g.k
    sw = np.array([stats[j][0] for j in range(k)]) + 10 * np.finfo(float).eps
    sx = np.array([stats[j][1] for j in range(k)])
    sxx = np.array([stats[j][2] for j in range(k)])
    means = sx / sw[:, None]
    eye = np.eye(3)
    if g.cov == "tied":
        tot = sxx.sum(axis=0) - np.einsum("j,ja,jb->ab", sw, means, means)
        shared = tot / n + REG_COVAR * eye
        covs = np.repeat(shared[None], k, axis=0)
    else:
        covs = sxx / sw[:, None, None] - np.einsum("ja,jb->jab", means, means) + REG_COVAR * eye
        if g.cov == "diag":
            covs = np.array([np.diag(np.clip(np.diag(c), REG_COVAR, None)) for c in covs])
    g.weights, g.means, g.covs = sw / sw.sum(), means, covs


def _pass(feats: DataFrame, models: list[Gmm]) -> dict[int, dict]:
    """One distributed E-step for every given model → summed statistics.

    All components of all models are one matrix product per batch. A task sums its
    batches and sends one row per (model, component), whatever its number of rows.
    """
    coef = np.hstack([_density(g.weights, g.means, g.covs) for g in models])
    sizes = np.array([g.k for g in models])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids = np.repeat([g.model_id for g in models], sizes)
    comps = np.concatenate([np.arange(k) for k in sizes])

    def run(batches):
        sums, ll = np.zeros((len(ids), _TERMS)), np.zeros(len(sizes))
        seen = False
        for pdf in batches:
            X = pdf[FEATURES].to_numpy(dtype=float)
            for i in range(0, len(X), EM_BATCH):
                terms = _terms(X[i:i + EM_BATCH])
                lp = terms @ coef
                top = np.maximum.reduceat(lp, begin, axis=1)
                lp = np.exp(lp - np.repeat(top, sizes, axis=1))
                total = np.add.reduceat(lp, begin, axis=1)
                lp /= np.repeat(total, sizes, axis=1)
                sums += lp.T @ terms
                ll += (np.log(total) + top).sum(axis=0)
                seen = True
        if seen:
            yield pd.DataFrame({"model_id": ids, "comp": comps, **{c: sums[:, i] for i, c in enumerate(_STATS)},
                                "ll": np.where(comps == 0, np.repeat(ll, sizes), 0.0)})

    parts = feats.select(*FEATURES).mapInPandas(run, _STATS_SCHEMA)
    summed = parts.groupBy("model_id", "comp").agg(*[F.sum(c).alias(c) for c in [*_STATS, "ll"]]).collect()
    out: dict[int, dict] = {}
    for r in summed:
        d = out.setdefault(r["model_id"], {"ll": 0.0, "comps": {}})
        d["ll"] += r["ll"]
        xx = np.zeros((3, 3))
        for i, (a, b) in enumerate(_SQUARES):
            xx[a, b] = xx[b, a] = r[_STATS[4 + i]]
        d["comps"][r["comp"]] = (r["t0"], np.array([r["t1"], r["t2"], r["t3"]]), xx)
    return out


def n_parameters(k: int, cov: str, d: int = 3) -> int:
    """free parameters of a mixture (means, weights, covariances)."""
    cov_p = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d}[cov]
    return k * d + (k - 1) + cov_p


def bic(log_likelihood: float, k: int, cov: str, n: int) -> float:
    return -2.0 * log_likelihood + n_parameters(k, cov) * math.log(n)


# ── Starts: k-means|| candidates, then Lloyd passes, all over every customer ──

SEED_ROUNDS = 2
SEED_PER_ROUND = 2 * MAX_K      # expected candidates that a round adds per start
LLOYD_PASSES = 5
_CENTRE_SCHEMA = "model_id int, comp int, n double, s0 double, s1 double, s2 double, cost double"


def _squared_distances(X: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (X * X).sum(1)[:, None] - 2 * X @ centres.T + (centres * centres).sum(1)[None]
    return np.maximum(d, 0.0)


def _centre_pass(feats: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per set of centres: customers and coordinate sums by nearest centre, and the total squared distance."""

    def run(batches):
        acc = [np.zeros((len(c), 5)) for c in centres]
        for pdf in batches:
            X = pdf[FEATURES].to_numpy(dtype=float)
            for a, c in zip(acc, centres, strict=True):
                d = _squared_distances(X, c)
                near = d.argmin(axis=1)
                a[:, 0] += np.bincount(near, minlength=len(c))
                for j in range(3):
                    a[:, 1 + j] += np.bincount(near, X[:, j], minlength=len(c))
                a[:, 4] += np.bincount(near, d[np.arange(len(X)), near], minlength=len(c))
        yield pd.DataFrame([(m, j, *row) for m, a in enumerate(acc) for j, row in enumerate(a.tolist())],
                           columns=["model_id", "comp", "n", "s0", "s1", "s2", "cost"])

    rows = (feats.select(*FEATURES).mapInPandas(run, _CENTRE_SCHEMA).groupBy("model_id", "comp")
            .agg(*[F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2", "cost")]).collect())
    out = [(np.zeros(len(c)), np.zeros((len(c), 3)), 0.0) for c in centres]
    for r in rows:
        n, sums, cost = out[r["model_id"]]
        n[r["comp"]], sums[r["comp"]] = r["n"], (r["s0"], r["s1"], r["s2"])
        out[r["model_id"]] = (n, sums, cost + r["cost"])
    return out


def _add_candidates(feats: DataFrame, centres: list[np.ndarray], costs: list[float], turn: int) -> list[np.ndarray]:
    """One k-means|| round: each customer joins a start's candidates with probability ∝ its squared distance."""
    chance = [F.xxhash64("customer_id", F.lit(turn), F.lit(s)).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
              for s in range(len(centres))]

    def run(batches):
        for pdf in batches:
            X = pdf[FEATURES].to_numpy(dtype=float)
            for s, c in enumerate(centres):
                if costs[s] > 0 and len(X):
                    p = SEED_PER_ROUND * _squared_distances(X, c).min(axis=1) / costs[s]
                    took = X[pdf[f"u{s}"].to_numpy() < p]
                    yield pd.DataFrame({"s": np.full(len(took), s), "x": took[:, 0], "y": took[:, 1], "z": took[:, 2]})

    rows = feats.select(*FEATURES, *[u.alias(f"u{s}") for s, u in enumerate(chance)]).mapInPandas(
        run, "s int, x double, y double, z double").collect()  # about SEED_PER_ROUND per start
    more = [sorted((r["x"], r["y"], r["z"]) for r in rows if r["s"] == s) for s in range(len(centres))]
    return [np.vstack([c, m]) if m else c for c, m in zip(centres, more, strict=True)]


def _weighted_seeds(cand: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over the weighted candidates of one start."""
    centres = [cand[rng.choice(len(cand), p=weights / weights.sum())]]
    while len(centres) < k:
        d = _squared_distances(cand, np.array(centres)).min(axis=1) * weights
        total = d.sum()
        centres.append(cand[rng.choice(len(cand), p=d / total) if total > 0 else rng.integers(len(cand))])
    return np.array(centres, dtype=float)


def starts(feats: DataFrame, ks: list[int], n_init: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(k, start) → (means, weights) of a k-means fit over every customer.

    Candidates are drawn from all customers in proportion to their squared distance
    (k-means||), weighted by the customers nearest to them, reduced to k by k-means++,
    and refined by Lloyd passes. Every pass serves all starts (and all k) at once and
    returns sums per centre; only the candidates, some dozens per start, reach the driver.
    """
    first = feats.agg(*[F.min_by(F.struct(*FEATURES), F.struct(F.xxhash64("customer_id", F.lit(s)), "customer_id")).alias(f"s{s}")
                        for s in range(n_init)]).first()
    cand = [np.array([list(first[f"s{s}"])], dtype=float) for s in range(n_init)]
    for turn in range(SEED_ROUNDS):
        cand = _add_candidates(feats, cand, [x[2] for x in _centre_pass(feats, cand)], turn)
    weights = [x[0] for x in _centre_pass(feats, cand)]
    keys = [(k, s) for k in ks for s in range(n_init)]
    centres = [_weighted_seeds(cand[s], weights[s], k, np.random.default_rng(42 + 1000 * k + s)) for k, s in keys]
    for _ in range(LLOYD_PASSES):
        got = _centre_pass(feats, centres)
        sizes = [n for n, _, _ in got]
        centres = [np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
                   for (n, sums, _), c in zip(got, centres, strict=True)]
    return {key: (c, (n + 1) / (n + 1).sum()) for key, c, n in zip(keys, centres, sizes, strict=True)}


@dataclass
class SweepResult:
    best: Gmm
    models: list[Gmm]
    n: int
    table: list[dict]


def gmm_sweep(rfm: DataFrame, ks: list[int] | None = None, cov_types=tuple(COV_TYPES), n_init: int = N_INIT,
              max_iter: int = MAX_ITER, tol: float = TOL) -> SweepResult:
    """F1 + F2: fit every (k, covariance, start) model by EM, keep the lowest BIC.

    ``rfm`` needs customer_id and the three scaled columns; persist it first.
    """
    feats = rfm.select("customer_id", *FEATURES).na.drop()
    head = feats.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)],
                     *[F.avg(F.col(a) * F.col(b)).alias(f"c{i}{j}") for i, a in enumerate(FEATURES)
                       for j, b in enumerate(FEATURES)]).first()
    n = head["n"]
    if n < MIN_CUSTOMERS:
        raise ValueError(f"{n} customers are too few for segments, {MIN_CUSTOMERS} is the least")
    # one EM task per ~200k customers (at least one per core); fewer, fuller tasks
    # keep the per-pass cost near the numpy work itself. coalesce: no shuffle.
    try:
        cores = feats.sparkSession.sparkContext.defaultParallelism
        want = max(cores, math.ceil(n / EM_ROWS_PER_TASK))
        if feats.rdd.getNumPartitions() > want:
            feats = feats.coalesce(want)
    except PySparkNotImplementedError:  # no RDD view (Spark Connect): the partitions stay as they are
        pass
    mu = np.array([head[f"m{i}"] for i in range(3)])
    cov0 = np.array([[head[f"c{i}{j}"] for j in range(3)] for i in range(3)]) - np.outer(mu, mu)
    cov0 = cov0 + REG_COVAR * np.eye(3) + 1e-3 * np.eye(3) * max(np.trace(cov0) / 3, 1e-6)
    ks = ks or list(range(2, max_components(n) + 1))
    begin = starts(feats, ks, n_init)
    models: list[Gmm] = []
    for k in ks:
        for s in range(n_init):
            means, weights = begin[(k, s)]
            for cov in cov_types:
                c0 = cov0 if cov != "diag" else np.diag(np.diag(cov0))
                models.append(Gmm(len(models), k, cov, s, weights.copy(), means.copy(),
                                  np.repeat(c0[None], k, axis=0)))
    live = list(models)
    for it in range(max_iter):
        if not live:
            break
        stats = _pass(feats, live)
        still = []
        for g in live:
            st = stats.get(g.model_id)
            if st is None:
                g.converged = True
                continue
            lb = st["ll"] / n
            g.history.append(lb)
            prev = g.lower_bound
            g.lower_bound = lb
            g.n_iter = it + 1
            try:
                _mstep(g, st["comps"], n)
                np.linalg.cholesky(g.covs)
            except np.linalg.LinAlgError:
                g.converged, g.lower_bound = True, -np.inf  # degenerate fit: out of the race
                continue
            if abs(lb - prev) < tol:
                g.converged = True
            else:
                still.append(g)
        live = still
    # final log-likelihood with the final parameters
    ok = [g for g in models if np.isfinite(g.lower_bound)]
    final = _pass(feats, ok) if ok else {}
    table = []
    for g in ok:
        ll = final[g.model_id]["ll"] if g.model_id in final else g.lower_bound * n
        g.lower_bound = ll / n
        table.append({"model_id": g.model_id, "k": g.k, "covariance": g.cov, "start": g.start,
                      "log_likelihood": ll, "bic": bic(ll, g.k, g.cov, n), "iterations": g.n_iter,
                      "converged": g.converged})
    if not table:
        raise RuntimeError("every mixture fit failed")
    # per (k, cov) keep the best start (highest likelihood), then lowest BIC overall
    best_by = {}
    for row in table:
        key = (row["k"], row["covariance"])
        if key not in best_by or row["log_likelihood"] > best_by[key]["log_likelihood"]:
            best_by[key] = row
    winner = min(best_by.values(), key=lambda r: (r["bic"], r["k"]))
    for row in table:
        row["chosen"] = row["model_id"] == winner["model_id"]
    best = next(g for g in models if g.model_id == winner["model_id"])
    return SweepResult(best, models, n, table)


def assign_components(rfm: DataFrame, g: Gmm) -> DataFrame:
    """Hard component per customer under one fitted mixture (most responsible)."""
    coef = _density(g.weights, g.means, g.covs)
    cols = rfm.columns

    def run(batches):
        for pdf in batches:
            X = pdf[FEATURES].to_numpy(dtype=float)
            comp = np.zeros(len(X), dtype="int32")
            if len(X):
                comp = (_terms(X) @ coef).argmax(axis=1).astype("int32")
            yield pdf.assign(component=comp)

    schema = T.StructType(rfm.schema.fields + [T.StructField("component", T.IntegerType())])
    return rfm.select(*cols).mapInPandas(run, schema)


# ── F3 / F6 / F7: renumber, profile, label ──────────────────────────────────

def renumber_clusters(df: DataFrame, comp_col: str = "component", by: tuple[str, ...] = ()) -> DataFrame:
    """cluster ids 0.. by mean monetary, highest first (ties: component id); within each ``by`` group where given."""
    means = df.groupBy(*by, comp_col).agg(F.avg("monetary").alias("_mm"))
    w = Window.partitionBy(*by).orderBy(F.col("_mm").desc(), F.col(comp_col))
    remap = means.select(*by, comp_col, (F.row_number().over(w) - 1).alias("cluster"))
    return df.join(remap if by else F.broadcast(remap), [*by, comp_col]).drop(comp_col)


def cluster_profiles(labelled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """F6 + F7: per cluster size, share, means and the rank-based label; within each ``by`` group where given."""
    g = labelled.groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg("recency").alias("r_mean"),
        F.avg("frequency").alias("f_mean"), F.avg("monetary").alias("m_mean"))
    all_w = Window.partitionBy(*by)

    def norm(c):
        lo, hi = F.min(c).over(all_w), F.max(c).over(all_w)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.5))

    scored = g.withColumn("score", norm("m_mean") + norm("f_mean") - norm("r_mean"))
    rank = F.row_number().over(all_w.orderBy(F.col("score").desc(), F.col("cluster"))) - 1
    labels = F.array(*[F.lit(x) for x in SEGMENT_LABELS])
    total = F.sum("size").over(all_w)
    out = scored.select(
        *by, F.col("cluster").alias("cluster_id"),
        F.get(labels, F.least(rank, F.lit(len(SEGMENT_LABELS) - 1))).alias("label"),
        F.col("size").cast("bigint").alias("size"),
        F.round(F.col("size") / total * 100, 1).alias("pct_of_customers"),
        F.round("r_mean", 1).alias("avg_recency_days"),
        F.round("f_mean", 1).alias("avg_frequency"),
        # at half a cent the order of the sum must not decide
        F.round(F.round("m_mean", 6), 2).alias("avg_monetary"),
    )
    return out


def label_customers(labelled: DataFrame, profiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Customer → label (profiles hold one row per cluster, at most 8 in a group)."""
    lab = profiles.select(*by, F.col("cluster_id").alias("cluster"), "label")
    out = labelled.join(lab if by else F.broadcast(lab), [*by, "cluster"], "left")
    return out.withColumn("label", F.coalesce("label", F.format_string("Segment %d", F.col("cluster") + 1)))


# ── F12: deterministic quantile segments ─────────────────────────────────────

def composite_score(rfm: DataFrame) -> DataFrame:
    """M + F − R on the scaled columns, rounded to 1e-9 so cut comparisons are stable."""
    raw = F.col("monetary_scaled") + F.col("frequency_scaled") - F.col("recency_scaled")
    return rfm.withColumn("score", F.round(raw, 9))


def quantile_segments(rfm: DataFrame, k: int = 4) -> DataFrame:
    """component = how many of the k−1 exact score quantiles the score exceeds.

    Thresholds come from ``exact_quantiles`` (no global sort, no single-task
    window); the bucketing is a projection.
    """
    scored = composite_score(rfm)
    cuts = exact_quantiles(scored, "score", [j / k for j in range(1, k)])
    comp = F.lit(0)
    for c in cuts:
        if c is not None:
            comp = comp + F.when(F.col("score") > F.lit(c), 1).otherwise(0)
    return scored.withColumn("component", comp.cast("int"))


def segment_by_quantiles(rfm: DataFrame, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """F12 → F3 → F6/F7: (customers with cluster + label, profiles)."""
    lab = renumber_clusters(quantile_segments(rfm, k))
    prof = cluster_profiles(lab)
    return label_customers(lab, prof), prof


def segment_by_mixture(rfm: DataFrame, res: SweepResult | None = None,
                       **sweep_opts) -> tuple[DataFrame, DataFrame, SweepResult]:
    """F1 → F3 → F6/F7 with the BIC-chosen mixture (of a sweep that was made before, if given)."""
    res = res or gmm_sweep(rfm, **sweep_opts)
    lab = renumber_clusters(assign_components(rfm, res.best))
    prof = cluster_profiles(lab)
    return label_customers(lab, prof), prof, res


# ── F4: silhouette ───────────────────────────────────────────────────────────

def silhouette_sq_euclidean(labelled: DataFrame) -> float:
    """Spark's exact silhouette with squared Euclidean distance (O(n·k)).

    The reference's plain-Euclidean silhouette needs every pair of points; it
    has no exact form below O(n²), so it is not computed (see README).
    """
    va = VectorAssembler(inputCols=FEATURES, outputCol="features")
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster",
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(va.transform(labelled.withColumn("cluster", F.col("cluster").cast("double")))))


# ── F8 / F10 / F11 ──────────────────────────────────────────────────────

def customer_map(labelled: DataFrame) -> DataFrame:
    """F8: 2-D PCA coordinates per customer with its label payload."""
    va = VectorAssembler(inputCols=FEATURES, outputCol="features")
    vec = va.transform(labelled)
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vec)
    pts = model.transform(vec).withColumn("_pc", vector_to_array("pc"))
    return pts.select(
        F.round(F.col("_pc")[0], 4).alias("x"), F.round(F.col("_pc")[1], 4).alias("y"),
        F.col("cluster").alias("cluster_id"), "label", F.col("customer_id").cast("string"),
        F.round(F.coalesce("monetary", F.lit(0.0)), 2).alias("monetary"),
        F.coalesce(F.col("recency").cast("bigint"), F.lit(0)).alias("recency"),
        F.coalesce(F.col("frequency").cast("bigint"), F.lit(0)).alias("frequency"))


def map_scaled(points: DataFrame) -> DataFrame:
    """x, y min-max scaled to the unit box (a zero range divides by 1)."""
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])

    def unit(c):
        lo, hi = box.select(f"lo_{c}").scalar(), box.select(f"hi_{c}").scalar()
        return (F.col(c) - lo) / F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)

    return points.withColumn("sx", unit("x")).withColumn("sy", unit("y"))


def map_centroids(points: DataFrame) -> DataFrame:
    """mean x, y per label."""
    return points.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"),
                                       F.count(F.lit(1)).alias("points"))


def segment_comparison(profiles: DataFrame) -> DataFrame:
    """each metric as % of the largest segment value (largest at least 1)."""
    w = Window.partitionBy()
    cols = []
    for c in ("avg_monetary", "avg_frequency", "avg_recency_days"):
        mx = F.greatest(F.max(c).over(w), F.lit(1.0))
        cols.append(F.round(F.col(c) / mx * 100, 1).alias(f"{c}_pct"))
    return profiles.select("cluster_id", "label", *cols)
