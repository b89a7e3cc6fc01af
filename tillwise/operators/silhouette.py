"""the silhouette of segments with plain Euclidean distances, without a table of pairs.

A point's mean distance to a segment needs the distance to each of its points. Points far away are taken a cell at a
time: a cell of a cubic grid has per segment its number of points, their mean and their second moments, and the sum
of their distances from x is ``n d + (tr S - u'S u) / 2d`` (d: distance from the mean, u: its direction), whose error falls
with the third power of the cell's size. Cells near x are taken by their sub-cells, in the same way; a sub-cell of one
point is exact. So the work per point is bounded by the numbers of cells, which are bounded by parameters: it grows
linearly with the points. The grid is as fine as ``max_cells`` allows, one aggregate per level.

Nothing per point leaves the tasks but its silhouette's sum. Points without all three coordinates or a segment are left
out; a segment of one point counts 0, and so does everything where there is only one segment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import FEATURES

MAX_CELLS = 6000     # occupied cells of the coarse grid, segments counted apart
SUB = 4              # sub-cells per side of a cell
NEAR = 4.0           # cells within so many times their half diagonal are taken by sub-cells
MAX_LEVEL = 9
_MOMENTS = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]


def _places(low: list[float], side: float, cells: int) -> list[Column]:
    return [F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((F.col(c) - F.lit(lo)) / F.lit(side) * cells))).cast("int")
            for c, lo in zip(FEATURES, low, strict=True)]


def _grid(points: DataFrame, low: list[float], side: float, cells: int) -> pd.DataFrame:
    """One row per occupied cell and segment: its place, number of points, mean and second moments."""
    at = [p.alias(f"k{i}") for i, p in enumerate(_places(low, side, cells))]
    sums = points.select("cluster", *at, *FEATURES).groupBy("cluster", "k0", "k1", "k2").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[a], FEATURES[b]).alias(f"s{i}") for i, (a, b) in enumerate(_MOMENTS)])
    return sums.toPandas()  # MAX_CELLS rows, or SUB ** 3 times as many


def _distance_sums(x: np.ndarray, mean: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """points x cells: sums of the distances from every point to the points of every cell."""
    away = x[:, None, :] - mean[None]
    d = np.sqrt((away * away).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        u = away / d[:, :, None]
        along = sum((1 if a == b else 2) * s[None, :, i] * u[:, :, a] * u[:, :, b] for i, (a, b) in enumerate(_MOMENTS))
        spread = s[:, 0] + s[:, 1] + s[:, 2]
        more = np.where(d > 0, (spread[None] - along) / (2 * d), 0.0)
    # right at a cell's mean the expansion does not hold: the spread is the bound and the best guess there
    typical = np.sqrt(np.maximum(spread, 0.0))[None]
    return n[None] * np.where(d >= typical, d + more, np.maximum(d, 0.9 * typical))


def euclidean_silhouette(labelled: DataFrame, max_cells: int = MAX_CELLS) -> float:
    """Mean silhouette over all points of ``labelled`` (cluster and the three scaled features)."""
    points = labelled.select(F.col("cluster").cast("int").alias("cluster"), *FEATURES).na.drop()
    box = points.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(FEATURES) for n, f in (("lo", F.min), ("hi", F.max))],
                     F.count("*").alias("n"), F.count_distinct("cluster").alias("k")).first()
    if box["n"] == 0 or box["k"] < 2:
        return 0.0
    low = [box[f"lo{i}"] for i in range(3)]
    side = max(max(box[f"hi{i}"] - low[i] for i in range(3)), 1e-12) * (1 + 1e-9)
    level = [F.approx_count_distinct(F.struct("cluster", *_places(low, side, 1 << v))).alias(f"c{v}") for v in range(2, MAX_LEVEL + 1)]
    counts = points.agg(*level).first()
    chosen = max((v for v in range(2, MAX_LEVEL + 1) if counts[f"c{v}"] <= max_cells), default=2)
    cells = 1 << chosen
    coarse, fine = _grid(points, low, side, cells), _grid(points, low, side, cells * SUB)
    if len(coarse) == 0:
        return 0.0
    sizes = coarse.groupby("cluster")["n"].sum()
    clusters = sizes.index.to_numpy()
    number = {c: i for i, c in enumerate(clusters)}

    def arrays(t: pd.DataFrame):
        t = t.assign(c=t["cluster"].map(number))
        return (t[["m0", "m1", "m2"]].to_numpy(float), t["n"].to_numpy(float), t[[f"s{i}" for i in range(6)]].to_numpy(float),
                t["c"].to_numpy(), t[["k0", "k1", "k2"]].to_numpy(np.int64))

    half = side / cells * np.sqrt(3) / 2
    shared = points.sparkSession.sparkContext.broadcast((arrays(coarse), arrays(fine), sizes.to_numpy(float), clusters))

    def run(batches):
        (mean, n, s, seg, place), (f_mean, f_n, f_s, f_seg, f_place), total, names = shared.value
        home = {}
        for i, p in enumerate(map(tuple, (f_place // SUB).tolist())):
            home.setdefault(p, []).append(i)
        centre = (place + 0.5) * (side / cells) + np.array(low)
        own_cells = list(map(tuple, place.tolist()))
        of = np.eye(len(names))
        score, seen = 0.0, 0
        for pdf in batches:
            x, c = pdf[FEATURES].to_numpy(float), np.searchsorted(names, pdf["cluster"].to_numpy())
            key = np.clip(np.floor((x - np.array(low)) / side * cells), 0, cells - 1).astype(np.int64)
            order = np.lexsort(key.T)
            cuts = np.flatnonzero(np.any(np.diff(key[order], axis=0), axis=1)) + 1
            for rows in np.split(order, cuts):
                if not len(rows):
                    continue
                middle = (key[rows[0]] + 0.5) * (side / cells) + np.array(low)
                near = ((centre - middle) ** 2).sum(axis=1) <= ((NEAR + 1) * half) ** 2
                subs = np.array(sorted({j for p in {own_cells[i] for i in np.flatnonzero(near)} for j in home[p]}), dtype=np.int64)
                for begin in range(0, len(rows), 256):  # bounded working set, also for a cell with very many points
                    some = rows[begin:begin + 256]
                    sums = _distance_sums(x[some], mean[~near], n[~near], s[~near]) @ of[seg[~near]]
                    sums += _distance_sums(x[some], f_mean[subs], f_n[subs], f_s[subs]) @ of[f_seg[subs]]
                    mine = c[some]
                    at = np.arange(len(some))
                    a = sums[at, mine] / np.maximum(total[mine] - 1, 1)
                    others = sums / total[None]
                    others[at, mine] = np.inf
                    b = others.min(axis=1)
                    top = np.maximum(a, b)
                    value = np.where((total[mine] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
                    score, seen = score + float(value.sum()), seen + len(some)
        yield pd.DataFrame({"s": [score], "n": [seen]})

    out = points.mapInPandas(run, "s double, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return out["s"] / out["n"]
