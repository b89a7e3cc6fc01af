"""Helpers shared by the training-data operators: shared tables, ranks, apportionment, word splits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffles_deleted

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillwise-llm/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str, dictionary: bool = True, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The table cuts the lineage: a task that is run again after an executor is lost
    reads files instead of replaying the plan. Write commits are Spark's own, so a
    repeated attempt never leaves a row twice. The write's shuffle files go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_deleted(spark):
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Delete the files of a ``write_shared`` table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tillwise-llm/" in root:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other character stays as it is."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def n_space_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs in the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("bigint")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 0 in ``order`` without a single-partition window.

    Range partitions are sorted and written, so that partition and position are
    fixed; a row's number is the count of rows in earlier partitions (one row per
    partition) plus its position in its own.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = write_shared(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                          .withColumn("_at", F.monotonically_increasing_id()), name)
    part, pos = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # a row per partition
    before, offset = 0, []
    for p in sorted(sizes):
        offset.append((p, before))
        before += sizes[p]
    offsets = spark.createDataFrame(offset or [(0, 0)], "_p bigint, _before bigint")
    return (placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(name, F.col("_before") + pos).drop("_at", "_p", "_before"))


def sainte_lague(df: DataFrame, votes: str, seats: int, ties: list[str], out: str = "seats") -> DataFrame:
    """Give ``seats`` to the rows of ``df`` by the highest quotients ``votes / (k - 1/2)``.

    The quotients are never listed: a divisor ``d`` gives a row ``floor(votes / d + 1/2)``
    seats, and each aggregate evaluates 32 divisors to narrow the bracket around
    the wanted total. Only the quotients between the two last divisors are listed
    and ranked, ties going to the first row by the ``ties`` columns.
    """
    v = F.col(votes)
    if seats <= 0:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    n, total = df.agg(F.count(F.when(v > 0, 1)), F.sum(v)).first()
    if not n or not total:
        return df.withColumn(out, F.lit(0).cast("bigint"))

    def at(d: float) -> Column:
        return F.floor(v / F.lit(float(d)) + F.lit(0.5)).cast("bigint")

    # a row gets between votes/d - 1/2 and votes/d + 1/2 seats, which brackets the divisor
    lo, hi = total / (seats + n / 2 + 1), total / max(seats - n / 2 - 1, 0.25)
    if seats - n / 2 - 1 <= 0:
        hi = 4 * total
    n_lo = n_hi = None
    for _ in range(40):
        steps = [lo + (hi - lo) * i / 31 for i in range(32)]
        got = [int(x or 0) for x in df.agg(*[F.sum(at(d)).alias(f"d{i}") for i, d in enumerate(steps)]).first()]
        i = max((k for k in range(32) if got[k] >= seats), default=0)
        j = min((k for k in range(32) if got[k] <= seats), default=31)
        lo, hi, n_lo, n_hi = steps[min(i, j)], steps[max(i, j)], got[min(i, j)], got[max(i, j)]
        if n_lo == n_hi or n_lo - n_hi <= 1000 + n // 4 or hi - lo <= hi * 1e-14:
            break
    if n_hi == seats:
        return df.withColumn(out, at(hi))
    if n_lo == seats:
        return df.withColumn(out, at(lo))
    more = (df.select(*ties, v.alias("_v"), F.explode(F.expr(
                f"CASE WHEN floor({votes} / {lo!r}D + 0.5D) > floor({votes} / {hi!r}D + 0.5D) THEN sequence("
                f"CAST(floor({votes} / {hi!r}D + 0.5D) AS BIGINT) + 1, CAST(floor({votes} / {lo!r}D + 0.5D) AS BIGINT))"
                " END")).alias("_k"))
            .withColumn("_q", F.col("_v") / (F.col("_k") - F.lit(0.5)))
            .orderBy(F.desc("_q"), *[F.col(t).asc_nulls_last() for t in ties], "_k").limit(seats - n_hi)
            .groupBy(*ties).agg(F.count("*").alias("_more")))
    on = [df[t].eqNullSafe(more[t]) for t in ties]
    return (df.join(more.select(*[F.col(t).alias(f"_t_{t}") for t in ties], "_more"),
                    [df[t].eqNullSafe(F.col(f"_t_{t}")) for t in ties], "left")
            .withColumn(out, at(hi) + F.coalesce("_more", F.lit(0))).drop("_more", *[f"_t_{t}" for t in ties])) if on else df
