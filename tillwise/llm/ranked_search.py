"""Ranked lexical search: hashed max-sketches give upper bounds, exact scores follow in descending bound.

A text's terms are hashed to two rows of counters, a cell holding the greatest occurrence number of the terms that
meet there. An impact rises with the occurrence number, so the lesser of a term's two cells gives an upper bound of the
term's impact, and the sum over an item's terms bounds its score. A row has four to eight cells per distinct term, so
a term that the text lacks seldom finds two filled cells. The cells depend on the text alone: N, L and the
weights enter at lookup, so the sketches are an index that stays as documents come and that other items can use.

A search over a batch of items:

1. One scan of the index bounds every text for every item of the batch, in blocks of matrix products; each task
   sends its ``WAVE`` best texts per item. The best of all are scored exactly; the k-th score is the item's threshold.
2. A second scan lists every text whose bound reaches the threshold. They are scored in waves of descending bound; each
   wave raises the thresholds, and the search ends when no bound left reaches its item's threshold.

So no text is dropped that could be among the k best: the result is exact, and sketches, waves and batches decide only how
many texts are scored. Scores depend on the text only. Texts are named by two 64-bit hashes, so copies are one candidate, and
document ids join the best texts at the end.

Cases: null and term-free texts are in no result and do not count in N; items without terms have none; rows of one
item_id are one item with the terms of all; repeated document rows are ranked one after the other; equal scores
are ranked by id, null last; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_shared, write_shared

K = 10
WAVE = 40
GROWTH = 16
BATCH_ITEMS = 1024
#: Cells of the narrowest and the widest sketch row; texts of more terms share cells and have looser bounds.
NARROWEST, WIDEST = 64, 1 << 16
BLOCK_CELLS = 1 << 21
BATCH_BYTES = 8 << 20
#: Candidate texts up to here are broadcast (16 bytes of key and the items each), beyond they are joined by a shuffle.
BROADCAST_TEXTS = 200_000

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: every byte of a character beyond ASCII belongs
_LIMIT = 255  # a cell at its limit stands for any number of occurrences


def terms_of(text: bytes | None) -> list[bytes]:
    return _TERM.findall((text or b"").lower())


def hashes(terms) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    return np.fromiter(map(xxh3_64_intdigest, terms), np.uint64, len(terms))


def cell_places(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashed terms in the two rows of a sketch."""
    mask = np.uint64(width - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(32) & mask).astype(np.int64)


def sketch(counts: Counter) -> bytes:
    """Two rows of cells, each the greatest occurrence number of its terms, at most ``_LIMIT``."""
    width = min(WIDEST, max(NARROWEST, 1 << (4 * len(counts) - 1).bit_length()))
    n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), _LIMIT).astype(np.uint8)
    cells = np.zeros((2, width), np.uint8)
    for row, places in zip(cells, cell_places(hashes(counts), width), strict=True):
        np.maximum.at(row, places, n)
    return cells.tobytes()


def text_keys(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, the text and its two hashes ``h1`` and ``h2``."""
    text = F.col("text").cast("string")
    return docs.select(*keep, text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


class Index(NamedTuple):
    sketches: DataFrame  # id, h1, h2, n (terms with repeats), cells
    n_docs: int          # documents with a term
    n_terms: int         # their terms


def build_index(docs: DataFrame, id_col: str = "doc_id") -> Index:
    """Sketches of all documents that have a term, in the shared folder."""

    def run(batches):
        for b in batches:
            rows, size, texts = [], 0, b.column(1).cast(pa.large_binary())
            for i, t in enumerate(texts):
                if counts := Counter(terms_of(t.as_py())):
                    rows.append((i, counts.total(), sketch(counts)))
                    size += len(rows[-1][2])
                if size > BATCH_BYTES or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [*[b.column(c).take(pa.array([r[0] for r in rows], pa.int64())) for c in (0, 2, 3)],
                         pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                        names=["id", "h1", "h2", "n", "cells"])
                    rows, size = [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    rows = text_keys(docs.withColumn("_id", F.col(id_col)), "_id").mapInArrow(
        run, f"id {kind}, h1 bigint, h2 bigint, n bigint, cells binary")
    kept = write_shared(rows, "search-index", dictionary=False, compression="zstd")
    n_docs, n_terms = kept.agg(F.count("*"), F.sum("n")).first()
    return Index(kept, n_docs, n_terms or 0)


def document_frequencies(docs: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each of some terms; a task sends one row per term that it met."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        wanted, df = shared.value, Counter()
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                df.update(wanted.intersection(terms_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["term", "df"])

    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term binary, df bigint")
    return {bytes(r[0]): r[1] for r in sent.groupBy("term").agg(F.sum("df")).collect()}  # at most the items' terms


class Items(NamedTuple):
    ids: list
    terms: list[bytes]        # terms of all items that some document holds
    weights: list[int]
    places: list[np.ndarray]  # per item, places of its terms


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, index_docs: int, index_terms: int) -> int:
    return 10 + 90 * n * index_docs // index_terms


def impact(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weigh_items(rows: list, docs: DataFrame, n_docs: int) -> Items:
    """Items of (id, text) rows with their weighted terms."""
    texts: dict = {}
    for item, text in rows:
        texts.setdefault(item, set()).update(terms_of((text or "").encode("utf-8", "surrogatepass")))
    df = document_frequencies(docs, set().union(*texts.values()))
    terms = sorted(df)
    place = {t: i for i, t in enumerate(terms)}
    return Items(list(texts), terms, [weight(n_docs, df[t]) for t in terms],
                 [np.array(sorted(place[t] for t in x if t in place), dtype=np.int64) for x in texts.values()])


def block_bounds(cells: list[bytes], m: np.ndarray, items: Items, h: np.ndarray) -> np.ndarray:
    """items x texts: upper bounds of the scores of texts whose sketches are equally wide."""
    width = len(cells[0]) // 2
    table = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), 2, width)
    one, two = cell_places(h, width)
    tf = np.minimum(table[:, 0].take(one, axis=1), table[:, 1].take(two, axis=1)).T
    term, text = np.nonzero(tf)
    most = tf[term, text].astype(np.float64)
    most = np.where(most < _LIMIT, 1e9 * most / (1000 * most + 8 * m[text]), 1e6)
    weighted = np.zeros(tf.shape)
    weighted[term, text] = most * np.array(items.weights, dtype=np.float64)[term]
    sums = [weighted[p].sum(axis=0) for p in items.places]
    return np.ceil(np.array(sums) * (1 + 1e-9)).astype(np.int64)  # above any rounding of the sums


def _bounds(batches, items: Items, n_docs: int, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bounds of items x texts, h1, h2) of blocks of index rows."""
    h = hashes(items.terms)
    for b in batches:
        n = b.column("n").to_pylist()
        cells = [x.as_buffer() for x in b.column("cells")]
        m = np.array([length_norm(x, n_docs, n_terms) for x in n], dtype=np.float64)
        widths = np.array([x.size for x in cells], dtype=np.int64)
        keys = [b.column(c).to_numpy() for c in ("h1", "h2")]
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            step = max(1, BLOCK_CELLS // max(1, len(items.terms), int(width)))
            for i in range(0, len(rows), step):
                at = rows[i:i + step]
                yield block_bounds([cells[j].to_pybytes() for j in at], m[at], items, h), keys[0][at], keys[1][at]


def _candidates(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                                      names=["item", "h1", "h2", "bound"])


CANDIDATE = "item int, h1 bigint, h2 bigint, bound bigint"


def best_bounds(index: Index, shared, wave: int) -> DataFrame:
    """(item, h1, h2, bound): per item the ``wave`` texts of highest bound."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches):
        items = shared.value
        best: list[list] = [[] for _ in items.ids]
        held: list[set] = [set() for _ in items.ids]
        for bounds, h1, h2 in _bounds(batches, items, n_docs, n_terms):
            for q, row in enumerate(bounds):
                least = best[q][0][0] if len(best[q]) == wave else 0
                for i in np.flatnonzero(row > least):
                    x = (int(row[i]), int(h1[i]), int(h2[i]))
                    if x[1:] in held[q] or len(best[q]) == wave and x[0] <= best[q][0][0]:
                        continue
                    held[q].add(x[1:])
                    if len(best[q]) < wave:
                        heapq.heappush(best[q], x)
                    else:
                        held[q].discard(heapq.heapreplace(best[q], x)[1:])
        for q, heap in enumerate(best):
            yield _candidates([(q, h1, h2, b) for b, h1, h2 in heap])

    found = index.sketches.select("h1", "h2", "n", "cells").mapInArrow(run, CANDIDATE).distinct()
    return first_of_each(found, wave)


def first_of_each(found: DataFrame, wave: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "h1", "h2")
    return found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= wave).drop("_at")


def all_bounds(index: Index, shared, least: list[int], most: list[int]) -> DataFrame:
    """(item, h1, h2, bound): every text whose bound lies between an item's two limits, both included."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches):
        for bounds, h1, h2 in _bounds(batches, shared.value, n_docs, n_terms):
            rows = []
            for q, row in enumerate(bounds):
                at = np.flatnonzero((row >= least[q]) & (row <= most[q]))
                rows += zip([q] * len(at), h1[at].tolist(), h2[at].tolist(), row[at].tolist(), strict=True)
            yield _candidates(rows)

    return index.sketches.select("h1", "h2", "n", "cells").mapInArrow(run, CANDIDATE).distinct()


def exact_scores(docs: DataFrame, wanted: DataFrame, index: Index, shared) -> DataFrame:
    """(item, h1, h2, score) of the wanted (item, h1, h2) whose score is above 0."""
    n_docs, n_terms = index.n_docs, index.n_terms
    texts = wanted.groupBy("h1", "h2").agg(F.collect_set("item").alias("items"))  # at most the items of a batch
    if wanted.count() <= BROADCAST_TEXTS:
        texts = F.broadcast(texts)

    def run(batches):
        items = shared.value
        place = {t: i for i, t in enumerate(items.terms)}
        seen: set = set()  # saves scoring a copy again; the distinct below removes what it lets through
        for b in batches:
            out = []
            for h1, h2, of, text in zip(*[b.column(c).to_pylist() for c in ("h1", "h2", "items")],
                                        b.column("text").cast(pa.large_binary()), strict=True):
                if (h1, h2) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add((h1, h2))
                counts = Counter(terms_of(text.as_py()))
                m = length_norm(counts.total(), n_docs, n_terms)
                paid = {place[t]: items.weights[place[t]] * impact(counts[t], m) for t in place.keys() & counts.keys()}
                for q in of:
                    if score := sum(paid.get(p, 0) for p in items.places[q].tolist()):
                        out.append((q, h1, h2, score))
            yield _candidates(out).rename_columns(["item", "h1", "h2", "score"])

    found = text_keys(docs).join(texts, ["h1", "h2"]).select("h1", "h2", "items", "text")
    return found.mapInArrow(run, "item int, h1 bigint, h2 bigint, score bigint").distinct()


def thresholds(scores: DataFrame, n_items: int, k: int) -> list[int]:
    """Per item the k-th best score of distinct texts, 1 where there are fewer."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "h1", "h2")
    kth = scores.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).groupBy("item").agg(
        F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)
    out = [1] * n_items
    for r in kth.collect():  # a row per item of a batch
        out[r["item"]] = r["score"]
    return out


def limit_table(spark: SparkSession, name: str, limits: list[int]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(limits)), f"item int, {name} bigint"))


def _search_batch(docs: DataFrame, index: Index, items: Items, k: int, wave: int) -> DataFrame:
    """(item, h1, h2, score): the texts that any of the k best documents can have."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    n = len(items.ids)
    first = write_shared(best_bounds(index, shared, wave), "search-wave")
    scored = write_shared(exact_scores(docs, first, index, shared), "search-scores")
    least, cut = thresholds(scored, n, k), [0] * n
    for r in first.groupBy("item").agg(F.min("bound").alias("bound"), F.count("*").alias("n")).collect():
        cut[r["item"]] = r["bound"] if r["n"] == wave else 0  # fewer: all texts with a bound are in
    drop_shared(first)
    left = write_shared(all_bounds(index, shared, least, cut), "search-left")
    inside = F.col("bound") >= F.col("least")
    while True:
        rest = left.join(limit_table(spark, "least", least), "item").where(inside).join(limit_table(spark, "cut", cut), "item")
        rest = rest.where("bound <= cut").select("item", "h1", "h2", "bound")
        wave *= GROWTH
        ends = first_of_each(rest, wave).groupBy("item").agg(F.min("bound").alias("bound")).collect()  # a row per item
        if not ends:
            break
        low = [cut[q] + 1 for q in range(n)]  # nothing left of an item: above its cut
        for r in ends:
            low[r["item"]] = r["bound"]
        now = rest.join(limit_table(spark, "low", low), "item").where("bound >= low").select("item", "h1", "h2")
        more = write_shared(scored.unionByName(exact_scores(docs, now, index, shared)).distinct(), "search-scores")
        drop_shared(scored)
        scored, least, cut = more, thresholds(more, n, k), [min(c, x - 1) for c, x in zip(cut, low, strict=True)]
    out = write_shared(scored.join(limit_table(spark, "least", least), "item").where("score >= least").drop("least"), "search-best")
    drop_shared(left)
    drop_shared(scored)
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = K, index: Index | None = None, id_col: str = "doc_id",
           item_col: str = "item_id", wave: int = WAVE, batch_items: int = BATCH_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents. ``index`` may be one built before from the same documents."""
    spark, given = docs.sparkSession, index
    index = index or build_index(docs, id_col)
    kinds = docs.schema[id_col].dataType.simpleString(), queries.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_col} {kinds[1]}, rank int, {id_col} {kinds[0]}, score bigint")
    n_items = queries.select(item_col).distinct().count() if index.n_docs else 0
    n_batches = -(-n_items // batch_items)
    for i in range(n_batches):
        rows = queries.where(F.pmod(F.xxhash64(item_col), F.lit(n_batches)) == i).select(item_col, F.col("text").cast("string")).collect()
        items = weigh_items([tuple(r) for r in rows], docs, index.n_docs)  # a batch of the stated queries
        if not items.terms:
            continue
        best = _search_batch(docs, index, items, k, max(wave, k))
        ids = spark.createDataFrame(list(enumerate(items.ids)), f"item int, _item {kinds[1]}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        ranked = (index.sketches.select("id", "h1", "h2").join(best, ["h1", "h2"])
                  .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        done = ranked.join(F.broadcast(ids), "item").select(F.col("_item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = out.unionByName(write_shared(done, "search-result"))
        drop_shared(best)
    if given is None:
        drop_shared(index.sketches)
    return out


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), totals AS (
  SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), tf AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2
), w AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, big_n
), m AS (
  SELECT k, doc_id, 100 - 90 + (90 * len(w) * big_n) // big_l AS m FROM d, totals WHERE len(w) > 0
), scores AS (
  SELECT item_id, doc_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY 1, 2, 3
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= {K}
"""
