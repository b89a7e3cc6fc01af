"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Each source's target is its share by weight of ``budget_ratio`` times all words,
   never above ``max_epochs`` times its own words; what the stop leaves over is shared
   again by weight among the others until no target is above.
2. A source's documents are dealt by a seeded hash to shards of about
   ``docs_per_shard`` documents, so that a hot source is many shards. All blocks of
   ``block_words`` words are apportioned to the shards by the highest quotients of
   their part of the target: an integer quota of blocks per shard.
3. A shard's documents lie one after the other in seeded order as a stream of words.
   Its quota takes whole passes over the stream and then the first blocks of one more
   pass, so whole documents are taken but for one cut per shard. The block is the unit of
   account: a small one lets a source of a few words come near its target too.

Cases: null text counts 0 words and is never taken; a null source is a source of its
own, ordered last; rows that share doc_id, source and size are rows like any other
(which of the equal rows the cut meets makes no difference to the result); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, n_space_words, sainte_lague, write_shared

WEIGHTS = (5, 2, 1)
BUDGET_RATIO = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 8
DOCS_PER_SHARD = 1024
SEED = 42


def source_targets(sources: DataFrame, budget_ratio: float = BUDGET_RATIO, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to ``(source, weight, source_size)``: weighted shares that stop at ``max_epochs`` sizes.

    A pass is one aggregate: the words of the sources that stop and the weights of the
    rest give the next share per weight, which only grows; it ends when it stays.
    """
    stop = F.lit(max_epochs) * F.col("source_size")
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    share = budget_ratio * (total or 0) / (weights or 1)
    while True:
        over = F.lit(float(share)) * F.col("weight") > stop
        stopped, open_weight = sources.agg(F.sum(F.when(over, stop)), F.sum(F.when(~over, F.col("weight")))).first()
        if not open_weight:
            break
        again = (budget_ratio * (total or 0) - (stopped or 0)) / open_weight
        if again == share:
            break
        share = again
    return sources.withColumn("target", F.least(F.lit(float(share)) * F.col("weight"), stop.cast("double")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_ratio: float = BUDGET_RATIO,
        max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, docs_per_shard: int = DOCS_PER_SHARD,
        seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    sizes = write_shared(docs.select("doc_id", "source", n_space_words(F.col("text")).alias("size")), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    targets = write_shared(source_targets(ranked.withColumn("weight", weight.cast("bigint")), budget_ratio, max_epochs)
                           .withColumn("n_shards", F.ceil(F.col("n_docs") / docs_per_shard).cast("bigint"))
                           .select(F.col("source").alias("t_source"), "source_size", "target", "n_shards"), "mix-targets")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = (sizes.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
              .withColumn("key", order)
              .withColumn("shard", F.expr("CAST(conv(substr(key, 1, 8), 16, 10) AS BIGINT) % n_shards")))
    shards = write_shared(
        placed.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").alias("shard_size"))
        .withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size"))
                    .otherwise(F.lit(0.0))), "mix-shards")
    total = shards.agg(F.sum("source_size")).first()[0] and targets.agg(F.sum("source_size")).first()[0] or 0
    quotas = sainte_lague(shards, "votes", int(budget_ratio * total / block_words + 0.5), ["source", "shard"], "blocks")
    quotas = write_shared(
        quotas.withColumn("words", F.least(F.col("blocks") * block_words, F.col("shard_size") * max_epochs))
        .select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size", "words"), "mix-quotas")
    stream = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size")
    start = F.coalesce(F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = (placed.withColumn("start", start)
            .join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left"))
    passes = F.expr("CASE WHEN shard_size > 0 THEN words DIV shard_size ELSE 0 END")
    rest = F.col("words") - passes * F.col("shard_size")
    last = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), rest) - F.col("start"))
    return span.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("size") * passes + last).cast("bigint").alias("taken"))


#: The same steps over DuckDB: every quotient is listed and the highest are taken.
ORACLE_SQL = f"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER o AS j, coalesce(sum({MAX_EPOCHS} * source_size) OVER before, 0) AS stopped,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w, sum(source_size) OVER () AS total
  FROM per
  WINDOW o AS (ORDER BY {MAX_EPOCHS} * source_size / w, source NULLS LAST),
         before AS (ORDER BY {MAX_EPOCHS} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), share AS (
  SELECT min_by(({BUDGET_RATIO}::DOUBLE * total - stopped::DOUBLE) / open_w::DOUBLE, j) AS lam FROM ordered
  WHERE ({BUDGET_RATIO}::DOUBLE * total - stopped::DOUBLE) / open_w::DOUBLE * w <= {MAX_EPOCHS} * source_size
), t AS (
  SELECT source, source_size, n_docs, least(lam * w, ({MAX_EPOCHS} * source_size)::DOUBLE) AS target, total FROM ordered, share
), placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')) AS key,
         ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT
           % ceil(n_docs / {DOCS_PER_SHARD})::BIGINT AS shard
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), shards AS (
  SELECT source, shard, sum(size)::BIGINT AS shard_size,
         CASE WHEN source_size > 0 THEN target * sum(size)::BIGINT / source_size ELSE 0 END AS votes
  FROM placed GROUP BY source, shard, source_size, target
), seats AS (
  SELECT source, shard, count(*) AS blocks FROM (
    SELECT source, shard, k, votes / (k - 0.5::DOUBLE) AS q
    FROM (SELECT *, unnest(generate_series(1, ceil(votes / {BLOCK_WORDS})::BIGINT + 50)) AS k FROM shards WHERE votes > 0)
    ORDER BY q DESC, source NULLS LAST, shard, k
    LIMIT (SELECT floor({BUDGET_RATIO}::DOUBLE * coalesce(sum(size), 0) / {BLOCK_WORDS} + 0.5)::BIGINT FROM s))
  GROUP BY source, shard
), quotas AS (
  SELECT shards.source, shards.shard, shard_size,
         least(coalesce(blocks, 0) * {BLOCK_WORDS}, shard_size * {MAX_EPOCHS}) AS words
  FROM shards LEFT JOIN seats ON shards.source IS NOT DISTINCT FROM seats.source AND shards.shard = seats.shard
), spans AS (
  SELECT p.*, shard_size, words, coalesce(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY key, doc_id, size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard
)
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN shard_size > 0 THEN size * (words // shard_size)
          + greatest(0, least(start + size, words % shard_size) - start) ELSE 0 END)::BIGINT AS taken
FROM spans
"""
