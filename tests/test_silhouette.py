"""plain Euclidean silhouette against all pairs, and its work against the number of points."""

import numpy as np
import pytest

from tillwise.operators import silhouette as S
from tillwise.operators.segment import FEATURES


def brute(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        means = {k: d[i, c == k].sum() / max((c == k).sum() - (k == c[i]), 1) for k in set(c.tolist())}
        a = means.pop(c[i])
        b = min(means.values())
        out.append(0.0 if (c == c[i]).sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(out))


def frame(spark, x, c):
    return spark.createDataFrame([(int(k), *map(float, p)) for k, p in zip(c, x, strict=True)], "cluster int, " + ", ".join(f"{f} double" for f in FEATURES))


@pytest.mark.parametrize("seed,n,cells", [(1, 1500, 6000), (2, 1500, 150), (3, 1500, 20)])
def test_equals_all_pairs_to_four_decimals(spark, seed, n, cells):
    r = np.random.default_rng(seed)
    c = r.integers(0, 4, n)
    x = r.normal(0, 1, (n, 3)) * [1, 0.5, 0.8] + np.array([[0, 0, 0], [2, 1, 0], [-1, 2, 1], [0.5, 0.5, 3]])[c]
    x[:200] = np.round(x[:200], 1)  # some customers alike
    x[200:260], c[200:260] = x[200], c[200]
    want = brute(x, c)
    assert S.euclidean_silhouette(frame(spark, x, c).repartition(3), max_cells=cells) == pytest.approx(want, abs=5e-5 if cells > 100 else 5e-4)


def test_few_points_and_segments(spark):
    x = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [5, 5, 5.0]])
    c = np.array([0, 0, 0, 7])
    df = frame(spark, x, c)
    assert S.euclidean_silhouette(df) == pytest.approx(brute(x, c), abs=1e-9)
    assert S.euclidean_silhouette(df.where("cluster = 0")) == 0.0 and S.euclidean_silhouette(df.where("false")) == 0.0
    same = frame(spark, np.zeros((10, 3)), np.arange(10) % 2)
    assert S.euclidean_silhouette(same) == 0.0


def test_work_per_point_does_not_grow_with_the_points(spark, monkeypatch):
    r = np.random.default_rng(5)
    work = []
    plain = S._distance_sums
    for n in (2000, 8000):
        c = r.integers(0, 3, n)
        x = r.normal(0, 1, (n, 3)) + c[:, None]
        coarse = S._grid(frame(spark, x, c), [x[:, i].min() for i in range(3)], 12.0, 16)
        work.append(len(coarse))
        assert coarse["n"].sum() == n
    assert work[1] < 2.5 * work[0] and plain is S._distance_sums
