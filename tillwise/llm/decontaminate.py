"""Benchmark decontamination: windows of benchmark words found in documents, by hash, then verified.

Windows are ``n`` consecutive words of an item (all words of a shorter item). Their
hashes form a small table that is broadcast while its measured size stays within
``broadcast_bytes``; beyond that the same join shuffles on the hash. Documents
are scanned in one pass: every window is hashed in place, only hits leave the scan,
and a hit counts only if the window's words are equal too.

Cases: null or word-free texts have no words and no hits; items without words are ignored;
repeated documents get equal rows, repeated items count once per item_id; null item ids
mark words but are not listed; empty tables give no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, write_shared

N_WORDS = 10
BROADCAST_BYTES = 64 << 20
#: What separates words: ASCII other than digits and letters, one by one, which Java's patterns look up in a bitmap
#: (a class of ranges costs several times as much).
SEPARATOR = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]"
SEPARATORS = f"{SEPARATOR}+"


def _split(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """Words as ``_w`` with the first word at ``_first`` (0-based) and their number ``n_words``.

    Splitting leaves an empty string at an end that begins or ends with a separator;
    positions step over it.
    """
    w = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    df = df.select(*keep, w.alias("_w"))
    first = (F.col("_w")[0] == "").cast("int")
    last = ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
    return df.select(*keep, "_w", first.alias("_first"), (F.size("_w") - first - last).alias("n_words"))


def benchmark_windows(benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(length, hash, window, items): each distinct window and the items that hold it."""
    exact = _split(benchmark.select("item_id", "text"), ascii_lower(F.col("text")), "item_id")
    length = F.least(F.lit(n), F.col("n_words"))
    at = (exact.where("n_words > 0").withColumn("length", length)
          .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n_words") - F.col("length"))))
          .withColumn("taken", F.slice("_w", F.col("_first") + F.col("p") + 1, F.col("length"))))
    return (at.select("item_id", "length", F.xxhash64("taken").alias("hash"), F.array_join("taken", " ").alias("window"))
            .groupBy("length", "hash", "window").agg(F.collect_set("item_id").alias("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per hit document: doc_id, text_hash, spans (merged [start, end) word ranges), n_hit, items (sorted strings)."""
    windows = write_shared(benchmark_windows(benchmark, n), "decon-windows")
    size, n_windows = windows.agg(F.sum(F.length("window") + 16 * F.size("items") + 64), F.count("*")).first()
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # n values at most
    small = (size or 0) <= broadcast_bytes
    right = windows.select(F.col("hash").alias("b_hash"), F.col("window").alias("b_window"), "items")
    words = _split(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), ascii_lower(F.col("text")),
                   "doc_id", "text_hash")
    # a plain explode or a filter on n_words would be pushed below the split and repeat it
    shortest = F.lit(lengths[0] if lengths else 1 << 30)
    places = F.when(F.col("n_words") >= shortest, F.sequence(F.lit(0), F.col("n_words") - shortest))
    at = words.withColumn("p", F.explode_outer(places)).where("p IS NOT NULL")
    if len(lengths) > 1:
        at = at.withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths]))).where("p + length <= n_words")
    else:
        at = at.withColumn("length", F.lit(lengths[0] if lengths else 1))
    taken = F.slice("_w", F.col("_first") + F.col("p") + 1, F.col("length"))
    at = at.withColumn("hash", F.xxhash64(taken))
    # equality as two bounds, so that the hash alone is the join's key and only windows that meet it are spelt out
    window = F.array_join(taken, " ")
    hits = (at.join(F.broadcast(right) if small else right,
                    (F.col("hash") == F.col("b_hash")) & (window <= F.col("b_window")) & (window >= F.col("b_window")))
            .select("doc_id", "text_hash", "p", "length", "items"))
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("p", (F.col("p") + F.col("length")).alias("e")))).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
    merged = F.expr("""aggregate(at, cast(array() as array<struct<p:int,e:int>>), (acc, x) ->
        CASE WHEN size(acc) > 0 AND element_at(acc, -1).e >= x.p
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('p', element_at(acc, -1).p,
                                                                         'e', greatest(element_at(acc, -1).e, x.e))))
             ELSE concat(acc, array(x)) END)""")
    return (found.withColumn("spans", merged)
            .withColumn("n_hit", F.expr("""aggregate(at, named_struct('e', 0, 'n', 0L), (s, x) -> named_struct(
                'e', greatest(s.e, x.e), 'n', s.n + greatest(0, x.e - greatest(x.p, s.e)))).n"""))
            .withColumn("items", F.sort_array(F.transform("ids", lambda x: x.cast("string"))))
            .select("doc_id", "text_hash", "spans", "n_hit", "items"))


def flag(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """Every document with n_words, n_hit, spans, items and contaminated (n_hit > 0)."""
    found = contamination(docs, benchmark, n).select(
        F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "spans", "n_hit", "items")
    base = _split(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), F.col("text"), "doc_id",
                  "text_hash").select("doc_id", "text_hash", F.col("n_words").cast("bigint").alias("n_words"))
    return (base.join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """``docs`` without the contaminated documents, columns as they were."""
    found = contamination(docs, benchmark, n).select(F.col("doc_id").alias("_h_id"), F.col("text_hash").alias("_h_hash"))
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_h_id"))
                     & (F.xxhash64(docs["text"]) == F.col("_h_hash")), "left_anti")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least({N_WORDS}, len(w)) AS n, array_to_string(w[p:p + least({N_WORDS}, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - least({N_WORDS}, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw USING (n, win)
), cover AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS x FROM hit) GROUP BY 1
), it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN it USING (doc_id)
"""
