"""Quality rules with host verdicts: rule failures by domain, shrunk by an empirical beta prior.

Each whole text is measured once and held against two base rules (too short, too much
repetition) and four soft rules (symbols, repeated lines, word length, capitals). Per
host (the document's source) the failing documents are counted; a beta prior fitted to
all hosts by moments shrinks the rates, so that a host of a few documents stays near the
overall rate. A host whose shrunk rate exceeds ``host_limit`` is strict. The verdict
joins back to the documents: a base failure goes at any host; at a strict host one
soft failure is enough; elsewhere it takes two, or one by twice its limit.

Cases: null and empty texts have no words and fail the base rule; a null source is a host
of its own; repeated rows give equal rows; an empty table gives an empty result; extra
columns pass through ``filter_documents`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Soft rules: the limit of each share; a word length outside the range counts as its distance over the range.
MAX_SYMBOLS_PER_WORD = 0.2
MAX_DUP_LINE_SHARE = 0.3
MAX_CAPITALS_SHARE = 0.4
WORD_CHARS = (3.0, 12.0)
HOST_LIMIT = 0.5
#: The prior is worth this many documents at least and at most, so that one bad document never makes a host strict.
STRENGTH_RANGE = (5.0, 1e4)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), len(lines),
            sum(len(w) > 1 and w.isupper() for w in words))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, measures): one row per document."""

    def run(batches):
        for b in batches:
            got = [measure(t.as_py()) for t in b.column("text")]
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("text_hash"), *cols],
                                             names=["doc_id", "source", "text_hash", *MEASURES])

    kinds = [docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")]
    return docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kinds[0]}, source {kinds[1]}, text_hash bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))


def _excess() -> dict[str, Column]:
    """How far each soft rule is broken: over 1 breaks it."""
    words, lines = F.greatest(F.lit(1), "n_words"), F.greatest(F.lit(1), "n_lines")
    mean, (low, high) = F.col("word_chars") / words, WORD_CHARS
    return {"symbols": F.col("n_symbols") / words / MAX_SYMBOLS_PER_WORD,
            "dup_lines": F.col("n_dup_lines") / lines / MAX_DUP_LINE_SHARE,
            "word_length": F.when(F.col("n_words") == 0, 0.0).otherwise(F.greatest(low / mean, mean / high)),
            "capitals": F.col("n_capitals") / words / MAX_CAPITALS_SHARE}


def host_rates(rules: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(source, n_docs, n_failed, host_rate, strict): failure rates shrunk by a beta prior of all hosts."""
    failed = F.col("base_failed") | (F.col("n_soft") > 0)
    hosts = rules.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    row = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.count("*"), F.sum(F.col("n_docs") * rate * rate),
                    F.sum(F.lit(1.0))).first()
    n, k, hosts_n = row[0] or 0, row[1] or 0, row[2] or 0
    mean = k / n if n else 0.0
    # moments: the spread of the rates over hosts, less what sampling alone would give
    spread = (row[3] / n - mean * mean) if n else 0.0
    within = mean * (1 - mean) * hosts_n / n if n else 0.0
    between = max(spread - within, 1e-9)
    strength = min(max(mean * (1 - mean) / between - 1, STRENGTH_RANGE[0]), STRENGTH_RANGE[1])
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("strict", F.col("host_rate") > host_limit)


def verdicts(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: doc_id, source, text_hash, measures, base_failed, n_soft, host_rate, strict, kept."""
    m = write_shared(measured(docs), "quality-measures")
    broken = list(_excess().values())
    rules = (m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
             .withColumn("n_soft", sum(((x > 1).cast("int") for x in broken), F.lit(0)))
             .withColumn("n_wide", sum(((x > 2).cast("int") for x in broken), F.lit(0))))
    hosts = host_rates(rules, host_limit).select(F.col("source").alias("h_source"), "host_rate", "strict")
    bad = (F.col("base_failed") | (F.col("n_soft") >= 2) | (F.col("n_wide") >= 1)
           | (F.col("strict") & (F.col("n_soft") >= 1)))
    return (rules.join(hosts, F.col("source").eqNullSafe(F.col("h_source")), "left").drop("h_source")
            .withColumn("kept", ~bad))


def filter_documents(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """``docs`` without the rejected documents, columns as they were."""
    gone = (verdicts(docs, host_limit).where(~F.col("kept"))
            .select(F.col("doc_id").alias("_g_id"), F.col("source").alias("_g_source"), F.col("text_hash").alias("_g_hash"))
            .distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_g_id")) & docs["source"].eqNullSafe(F.col("_g_source"))
                     & (F.xxhash64(docs["text"]) == F.col("_g_hash")), "left_anti")


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), g AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})
), rep AS (
  SELECT r, count(DISTINCT x) AS n FROM (
    SELECT g.r, unnest(generate_series(i, i + {WINDOW - 1})) AS x
    FROM g JOIN (SELECT r, gram FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (r, gram)) GROUP BY 1
), m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_capitals
  FROM d LEFT JOIN rep USING (r)
), x AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
         [n_symbols::DOUBLE / greatest(1, n_words) / {MAX_SYMBOLS_PER_WORD}::DOUBLE,
          n_dup_lines::DOUBLE / greatest(1, n_lines) / {MAX_DUP_LINE_SHARE}::DOUBLE,
          CASE WHEN n_words = 0 THEN 0 ELSE greatest({WORD_CHARS[0]}::DOUBLE / (word_chars::DOUBLE / n_words),
                                                     word_chars::DOUBLE / n_words / {WORD_CHARS[1]}::DOUBLE) END,
          n_capitals::DOUBLE / greatest(1, n_words) / {MAX_CAPITALS_SHARE}::DOUBLE] AS e
  FROM m
), y AS (
  SELECT *, len(list_filter(e, lambda v: v > 1)) AS n_soft, len(list_filter(e, lambda v: v > 2)) AS n_wide FROM x
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR n_soft > 0) AS k FROM y GROUP BY 1
), t AS (
  SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE / sum(n) AS mean, count(*) AS hosts, sum(k::DOUBLE * k / n) AS sq FROM h
), s AS (
  SELECT mean, least(greatest(mean * (1 - mean) / greatest(sq / n - mean * mean - mean * (1 - mean) * hosts / n, 1e-9) - 1, {STRENGTH_RANGE[0]}), {STRENGTH_RANGE[1]}) AS z
  FROM t
), v AS (
  SELECT source, (k + mean * z) / (n + z) > {HOST_LIMIT} AS strict FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_soft >= 2 OR n_wide >= 1 OR (strict AND n_soft >= 1)) AS kept, strict
FROM y JOIN v ON y.source IS NOT DISTINCT FROM v.source
"""
