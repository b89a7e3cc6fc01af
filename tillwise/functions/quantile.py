"""Exact, linearly interpolated quantiles that scale.

Spark's exact ``percentile`` merges every distinct value of the column in one
final task, which does not survive a 100 TB column of continuous values. Here
the order statistics are found by histogram refinement instead:

* pass 0: one aggregate gives ``count``, ``min``, ``max`` and approximate
  brackets ``percentile_approx(p ± 3/accuracy)`` around each wanted rank;
* each further pass: one aggregate (partial on the map side) counts rows per
  bucket (count, min, max) of the interval still holding each wanted rank,
  plus the rows below a fresh bracket; the driver walks at most ``buckets``
  rows per open interval and narrows it to the one bucket that holds the rank.
  A bucket with ``min == max`` is the answer. A bracket that turns out not to
  hold its rank (the sketch is approximate) falls back to [min, max], so the
  result is always exact; usually the first histogram already settles it.

Each pass shrinks an interval by about ``buckets``×, so doubles settle in a few
passes; the driver only ever holds ``buckets`` × (open ranks) small rows.
Interpolation follows the usual linear rule: position ``p·(n−1)``.
The input should be persisted by the caller when it is costly to recompute.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# passes made by the last call (for tests and tuning)
LAST_PASSES = {"n": 0}


APPROX_ACCURACY = 10000


def exact_quantiles(df: DataFrame, col: str, probs: list[float], buckets: int = 2048,
                    max_passes: int = 64) -> list[float | None]:
    """Exact linear-interpolated quantiles of ``col`` (nulls and NaN ignored)."""
    return exact_quantiles_multi(df, [col], probs, buckets, max_passes)[col]


def exact_quantiles_multi(df: DataFrame, cols: list[str], probs: list[float],
                          buckets: int = 2048, max_passes: int = 64) -> dict[str, list[float | None]]:
    """Same as ``exact_quantiles`` for several columns, sharing every pass."""
    vals = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    ok = {i: F.col(f"v{i}").isNotNull() & ~F.isnan(F.col(f"v{i}")) for i in range(len(cols))}
    delta = 3.0 / APPROX_ACCURACY
    bracket_probs = []
    for p in probs:
        bracket_probs += [max(0.0, p - delta), min(1.0, p + delta)]
    aggs = []
    for i in range(len(cols)):
        v = F.when(ok[i], F.col(f"v{i}"))
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.percentile_approx(v, bracket_probs, APPROX_ACCURACY).alias(f"br{i}")]
    head = vals.agg(*aggs).first()
    LAST_PASSES["n"] = 1

    # state: (col index, rank) -> [lo, hi, below]; found: (col index, rank) -> value
    state: dict[tuple[int, int], list] = {}
    found: dict[tuple[int, int], float] = {}
    wanted: dict[int, list[tuple[int, int, float]]] = {}
    for i in range(len(cols)):
        n = head[f"n{i}"]
        wanted[i] = []
        if not n:
            continue
        br = head[f"br{i}"]
        for j, p in enumerate(probs):
            pos = p * (n - 1)
            k = int(math.floor(pos))
            frac = pos - k
            k2 = min(k + 1, n - 1)
            wanted[i].append((k, k2, frac))
            for r in (k, k2):
                if head[f"lo{i}"] == head[f"hi{i}"]:
                    found[(i, r)] = head[f"lo{i}"]
                elif br is not None and br[2 * j] is not None:
                    # approximate bracket; rows below it are counted in the next pass
                    state.setdefault((i, r), [br[2 * j], br[2 * j + 1], None])
                else:
                    state.setdefault((i, r), [head[f"lo{i}"], head[f"hi{i}"], 0])
    full = {i: (head[f"lo{i}"], head[f"hi{i}"]) for i in range(len(cols))}

    for _ in range(max_passes):
        open_keys = [k for k in state if k not in found]
        if not open_keys:
            break
        # distinct open intervals, each gets a slot id
        slots: dict[tuple, int] = {}
        for key in open_keys:
            i = key[0]
            lo, hi, below = state[key]
            slots.setdefault((i, lo, hi, below), len(slots))
        entries = []
        for (i, lo, hi, below), sid in slots.items():
            v = F.col(f"v{i}")
            if hi > lo:
                # halved first: the range of two extreme doubles may not be a double
                b = F.least(F.floor((v / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * F.lit(buckets)).cast("int"),
                            F.lit(buckets - 1))
            else:
                b = F.lit(0)
            entries.append(F.when(ok[i] & (v >= F.lit(lo)) & (v <= F.lit(hi)),
                                  F.struct(F.lit(sid).alias("s"), b.alias("b"), v.alias("v"))))
            if below is None:  # count the rows under a fresh bracket in the same pass
                entries.append(F.when(ok[i] & (v < F.lit(lo)),
                                      F.struct(F.lit(sid).alias("s"), F.lit(-1).alias("b"), v.alias("v"))))
        exploded = vals.select(F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("e"))
        hist = (exploded.groupBy(F.col("e.s").alias("s"), F.col("e.b").alias("b"))
                .agg(F.count(F.lit(1)).alias("c"), F.min("e.v").alias("mn"), F.max("e.v").alias("mx"))
                .collect())
        LAST_PASSES["n"] += 1
        by_slot: dict[int, list] = {}
        for row in hist:
            by_slot.setdefault(row["s"], []).append(row)
        for rows in by_slot.values():
            rows.sort(key=lambda r: r["b"])
        for key in open_keys:
            i, r = key
            lo, hi, below = state[key]
            sid = slots[(i, lo, hi, below)]
            rows = by_slot.get(sid, [])
            if below is None:
                below = sum(row["c"] for row in rows if row["b"] == -1)
            cum = below
            for row in rows:
                if row["b"] < 0:
                    continue
                if cum <= r < cum + row["c"]:
                    if row["mn"] == row["mx"]:
                        found[key] = row["mn"]
                    else:
                        state[key] = [row["mn"], row["mx"], cum]
                    break
                cum += row["c"]
            else:
                if state[key][2] is None:   # the approximate bracket missed: search everything
                    state[key] = [full[i][0], full[i][1], 0]
                else:  # pragma: no cover - only on inconsistent input between passes
                    raise RuntimeError(f"rank {r} not found while refining quantiles of {cols[i]}")

    unsettled = sorted({cols[i] for i, r in state if (i, r) not in found})
    if unsettled:
        raise RuntimeError(f"quantiles of {unsettled} are not settled after {max_passes} passes of {buckets} buckets")
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        if not wanted[i]:
            out[c] = [None] * len(probs)
            continue
        res = []
        for k, k2, frac in wanted[i]:
            a, b = found[(i, k)], found[(i, k2)]
            res.append(a + (b - a) * frac)
        out[c] = res
    return out


def grouped_quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of every group: ``keys``, then ``{col}_q{i}`` per column and probability.

    However many groups there are and however large one is: the distinct values of a group with their counts
    (combined on the map side) are range-partitioned by (group, value), so a large group lies in several partitions.
    A value's first rank is the group's count in earlier partitions, one small row per partition and
    group, plus the running count in its own. No group and no state per group meets one task or the driver.
    Nulls and NaN are ignored; a group without values has null quantiles.
    """
    from ..session import scratch_table
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    values = (df.select(*keys, F.inline(pairs)).where("v IS NOT NULL AND NOT isnan(v)")
              .groupBy(*keys, "c", "v").agg(F.count("*").alias("n")))
    # where the ranges are cut depends on a sample, so the partition of a row is fixed by writing it
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = scratch_table(values.repartitionByRange(width, *keys, "c", "v").withColumn("_p", F.spark_partition_id()), "quantile-values")
    group = [*keys, "c"]
    sizes = cut.groupBy(*group, "_p").agg(F.sum("n").alias("_in"))
    all_parts = Window.partitionBy(*group)
    # written, as the result is: a join knows their size before it moves the values, or the caller's rows, by group
    sizes = sizes.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(group)], F.col("_p").alias("_part"),
                         F.sum("_in").over(all_parts).alias("_total"),
                         (F.sum("_in").over(all_parts.orderBy("_p")) - F.col("_in")).alias("_before"))
    sizes = scratch_table(sizes, "quantile-sizes")
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(group)] + [F.col("_p") == F.col("_part")]
    placed = cut.join(sizes, same).select(*group, "_p", "v", "n", "_total", "_before")
    running = F.sum("n").over(Window.partitionBy(*group, "_p").orderBy("v"))
    placed = placed.withColumn("_to", F.col("_before") + running).withColumn("_from", F.col("_to") - F.col("n"))

    wanted = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("_total") - 1)
        low = F.floor(at)
        for side, rank in (("a", low), ("b", F.least(low + 1, F.col("_total") - 1))):
            wanted.append(F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("v"))).alias(f"{side}{i}"))
        wanted.append(F.max(at - low).alias(f"f{i}"))
    found = placed.groupBy(*group).agg(*wanted)
    by_col = found.select(*group, *[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}")).alias(f"q{i}")
                                    for i in range(len(probs))])
    wide = [F.max(F.when(F.col("c") == j, F.col(f"q{i}"))).alias(f"{c}_q{i}") for j, c in enumerate(cols) for i in range(len(probs))]
    return scratch_table(by_col.groupBy(*keys).agg(*wide), "quantiles")
