"""Rank and running sums over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table


def ranked(df: DataFrame, order: list[Column], running: dict[str, str] | None = None) -> DataFrame:
    """Add ``rank`` (from 1, in ``order``) and a running sum per entry of ``running`` (column → name).

    Rows are dealt to range partitions, sorted and written, which fixes their places. A row's
    rank is its place in its partition plus the rows of the partitions before; the same
    goes for sums. Only one row per partition passes through the driver.
    """
    running = running or {}
    placed = scratch_table(df.repartitionByRange(*order).sortWithinPartitions(*order)
                           .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sums = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in running])
    before, rows = [0] + [0.0] * len(running), []
    for r in sorted(sums.collect()):
        rows.append((r["p"], *before))
        before = [before[0] + r["n"], *[b + float(r[c] or 0.0) for b, c in zip(before[1:], running, strict=True)]]
    schema = ", ".join(["_p bigint", "_n bigint", *[f"_b{i} double" for i in range(len(running))]])
    offsets = df.sparkSession.createDataFrame(rows, schema)
    inside = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    out = out.withColumn("rank", (F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int"))
    for i, (c, name) in enumerate(running.items()):
        out = out.withColumn(name, F.col(f"_b{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0.0)))
    return out.drop("_p", "_n", "_at", *[f"_b{i}" for i in range(len(running))])
