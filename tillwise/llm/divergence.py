"""Source divergence audit: how far each source of a language speaks from the others, by exact matrix products.

A (lang, source) group gives each kept term of its lang the smoothed share ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``
and two shares are apart by ``f = floor((p - q)^2 / (p + q))``. A group's p depends on the term's *count level* in the
group only. So for a block of terms an indicator matrix has a row per term and a column per (group, level); multiplied by
its transpose it holds the joint table of levels of every pair of groups, and a pair's divergence is its joint table
priced with f. Products are of 0/1 numbers with at most ``BLOCK_TERMS`` rows, so they are exact in single precision;
p, f and the sums are integers.

Blocks: terms are dealt to blocks of near overall counts, so that a block has few levels. Groups come in blocks of
``BLOCK_GROUPS``, a task holds the cells of two such blocks for one block of terms, however many terms, groups or
documents there are. Terms with no count in either block of groups are in no table: their number times f of the two
level-0 shares is added at the end.

Counting: each task adds up terms of its documents in a bounded table and sends partial counts once; one shuffle
by (lang, term) then gives a cell's count, the lang's document frequency and the lang's count. A hot source is thus
a few partial rows per task and term.

Cases: null text, lang and source are empty strings; repeated rows are documents of their own; a group without terms
takes part with counts of 0; a lang without kept terms has pairs of value 0; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_shared, write_shared

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK_TERMS = 1024
BLOCK_GROUPS = 32
#: Entries of a task's table of counts before it is sent on.
TABLE_ENTRIES = 400_000

_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8: every byte of a character beyond ASCII belongs


def group_columns(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def partial_counts(docs: DataFrame, entries: int = TABLE_ENTRIES) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, summed over some documents of a task each."""

    def sent(tables):
        for (lang, source), (n, d) in tables.items():
            terms = list(n)
            for i in range(0, len(terms), 20_000):
                part = terms[i:i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()),
                     pa.array([d[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "d"])

    def run(batches):
        tables: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                words = _TERM.findall((text.as_py() or b"").lower())
                n, d = tables.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(words)
                d.update(set(words))
                size += len(n) - before
                if size > entries:
                    yield from sent(tables)
                    tables, size = {}, 0
        yield from sent(tables)

    return docs.select(*group_columns(docs), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "lang string, source string, term string, n bigint, d bigint")


def kept_cells(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts above 0 of the kept terms; ``first`` marks one cell per term."""
    of_term = Window.partitionBy("lang", "term")
    cells = (partial_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term")
             .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
             .withColumn("lang_d", F.sum("d").over(of_term)).where(F.col("lang_d") >= min_docs)
             .withColumn("lang_n", F.sum("n").over(of_term))
             .withColumn("first", F.col("source") == F.min("source").over(of_term)))
    return cells.select("lang", "source", "term", "n", "lang_n", "first")


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count; exact for any 64-bit count."""
    wide = [F.expr("CAST(1000000000 AS DECIMAL(10,0))"), (count + 2).cast("decimal(20,0)")]
    below = (total + 2 * terms).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", wide[0] * wide[1], below)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total, block): every occurring group with its N, its lang's V and N."""
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(F.col("first"), 1)).alias("firsts"))
    in_lang = Window.partitionBy("lang")
    return (docs.select(*group_columns(docs)).distinct().join(sums, ["lang", "source"], "left")
            .fillna(0, ["total", "firsts"])
            .withColumns({"terms": F.sum("firsts").over(in_lang), "lang_total": F.sum("total").over(in_lang),
                          "block": F.floor((F.row_number().over(in_lang.orderBy("source")) - 1) / BLOCK_GROUPS)})
            .drop("firsts"))


def price_block(sources: list, blocks: np.ndarray, totals: list[int], terms: int, row: np.ndarray, group: np.ndarray,
                count: np.ndarray) -> tuple[list[tuple], int]:
    """Pairs (i, j, summed f) of the groups of one block of terms, and its number of terms.

    ``row``, ``group`` and ``count`` are the cells above 0. The pairs are those within one block of groups, or those
    between two.
    """
    n_rows = int(row.max()) + 1
    counts = np.zeros((n_rows, len(sources)), dtype=np.int64)
    counts[row, group] = count
    columns, begin, p = [], [0], []
    for g, total in enumerate(totals):
        levels, code = np.unique(counts[:, g], return_inverse=True)
        one_hot = np.zeros((n_rows, len(levels)), dtype=np.float32)
        one_hot[np.arange(n_rows), code.reshape(-1)] = 1
        columns.append(one_hot)
        begin.append(begin[-1] + len(levels))
        p += [1 + SCALE * (int(x) + 2) // (total + 2 * terms) for x in levels]
    indicators, price, two = np.hstack(columns), np.array(p, dtype=np.int64), len(set(blocks.tolist())) > 1
    out = []
    for g in range(len(sources) - 1):
        low = begin[g + 1]
        joint = (columns[g].T @ indicators[:, low:]).astype(np.int64)
        a, b = price[begin[g]:low, None], price[None, low:]
        paid = (joint * ((a - b) ** 2 // (a + b))).sum(axis=0)
        for h in range(g + 1, len(sources)):
            if not two or blocks[g] != blocks[h]:
                out.append((sources[g], sources[h], int(paid[begin[h] - low:begin[h + 1] - low].sum())))
    return out, n_rows


def block_sums(cells: DataFrame, groups: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, item, paid, n_rows) per block of terms and pair of groups, source before item."""
    # terms of near counts lie in one band, a band is dealt to blocks of about block_terms by hash
    band = F.floor(4 * F.log2("lang_n")).cast("int")
    bands = (cells.where("first").groupBy("lang", band.alias("band")).agg(
        F.ceil(F.count("*") / block_terms).cast("int").alias("deals")))
    placed = (cells.withColumn("band", band).join(bands, ["lang", "band"])
              .withColumn("deal", F.pmod(F.xxhash64("term"), "deals").cast("int"))
              .join(groups.select("lang", "source", "block"), ["lang", "source"])
              .select("lang", "band", "deal", "block", "source", "term", "n", F.lit(0).cast("bigint").alias("terms")))
    n_blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks"))
    keys = bands.withColumn("deal", F.explode(F.expr("sequence(0, deals - 1)"))).select("lang", "band", "deal")
    # every group of a block is told to each block of terms, so that its level 0 has a column
    told = (groups.join(keys, "lang").select("lang", "band", "deal", "block", "source", F.lit(None).cast("string").alias("term"),
                                             F.col("total").alias("n"), "terms"))
    rows = (placed.unionByName(told).join(n_blocks, "lang")
            .withColumn("other", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
            .select("lang", "band", "deal", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                    "block", "source", "term", "n", "terms"))

    def price(table):
        is_group = table.column("term").is_null()
        told_here, here = table.filter(is_group).sort_by("source"), table.filter(pc.invert(is_group))
        out, n_rows = [], 0
        if here.num_rows:
            sources = told_here.column("source").to_pylist()
            place = {s: i for i, s in enumerate(sources)}
            row = here.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
            group = np.array([place[s] for s in here.column("source").to_pylist()])
            out, n_rows = price_block(sources, told_here.column("block").to_numpy(), told_here.column("n").to_pylist(),
                                      told_here.column("terms")[0].as_py(), row, group, here.column("n").to_numpy())
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array([x[0] for x in out], pa.string()),
                         "item": pa.array([x[1] for x in out], pa.string()), "paid": pa.array([x[2] for x in out], pa.int64()),
                         "n_rows": pa.array([n_rows] * len(out), pa.int64())})

    return rows.groupBy("lang", "band", "deal", "low", "high").applyInArrow(
        price, "lang string, source string, item string, paid bigint, n_rows bigint")


def pair_part(cells: DataFrame, groups: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, item, value): each pair of sources of a lang, both ways."""
    sums = block_sums(cells, groups, block_terms).groupBy("lang", "source", "item").agg(
        F.sum("paid").alias("paid"), F.sum("n_rows").alias("n_rows"))
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("total").alias(n), *extra)
                for s, n, extra in (("source", "n_one", ("terms",)), ("item", "n_two", ())))
    pairs = one.join(two, "lang").where("source < item").join(sums, ["lang", "source", "item"], "left")
    zero = F.lit(0).cast("bigint")
    nought = apart(share(zero, F.col("n_one"), F.col("terms")), share(zero, F.col("n_two"), F.col("terms")))
    value = F.when(F.col("terms") > 0, F.coalesce("paid", zero) + (F.col("terms") - F.coalesce("n_rows", zero)) * nought
                   ).otherwise(zero)
    half = pairs.select("lang", "source", "item", value.alias("value"))
    return half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def term_part(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): kept terms that a group uses more than its lang."""
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return (cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
            .where("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    cells = write_shared(kept_cells(docs, min_docs), "divergence-cells")
    groups = write_shared(groups_of(docs, cells), "divergence-groups")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_part(cells, groups, block_terms).withColumn("rank", F.row_number().over(ranked))
    terms = term_part(cells, groups).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    out = write_shared(pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
                       .select("lang", "source", "part", "item", "value", "rank"), "divergence")
    drop_shared(cells)
    drop_shared(groups)
    return out


ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), words AS (
  SELECT k, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY 1, 2 HAVING count(DISTINCT k) >= {MIN_DOCS}
), langs AS (
  SELECT d.lang, coalesce(v, 0) AS v, coalesce(n, 0) AS lang_total FROM (SELECT DISTINCT lang FROM docs) d
  LEFT JOIN (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY 1) USING (lang)
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), groups AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS total, v, lang_total FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY 1, 2) USING (lang, source) JOIN langs USING (lang)
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, lang_n, v, lang_total,
         1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (total + 2 * v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), every_pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM (SELECT *, 1 + ({SCALE}::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q FROM grid WHERE n > 0) WHERE p > q
), ranked AS (
  SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM every_pair
  UNION ALL
  SELECT 'term' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
