"""One registered query per training-data operator, over its whole table, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, divergence, licenses, line_dedup, mixing, pii, quality_classifier, quality_rules, ranked_search,
               secrets, simhash, tokens, warc)
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op3_benchmark_decontamination", decontaminate.ORACLE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items."""
    out = decontaminate.flag(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op5_source_mixing", mixing.ORACLE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@register("op4_personal_data")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts per base kind, digests of the base spans, all spans."""
    found = pii.find_spans(read_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select("doc_id", *[pii.count_kind(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
                        F.sha2(pii.listed(spans, pii.BASE_KINDS), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


@register("op7_quality_rules", quality_rules.ORACLE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, the base verdict and the verdict with its host's."""
    out = quality_rules.verdicts(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "strict")


@register("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word_bpe_49k vocabulary."""
    import public_tokenizers
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op9_warc_archives", warc.ORACLE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the index."""
    index = warc.write_archives(read_table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fuzzy dedup removes from every document."""
    out = line_dedup.line_report(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", (F.col("n_lines") - F.col("n_removed")).alias("n_kept"),
                      F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))


@register("op1_license_scan", licenses.ORACLE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names or quotes."""
    out = licenses.scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "license", "dice")


@register("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every document, alone and with its site's posterior."""
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts per base kind, digest of the base spans, all spans."""
    found = secrets.find_spans(read_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select("doc_id", *[secrets.count_kind(spans, k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
                        F.sha2(secrets.listed(spans, secrets.BASE_KINDS), 256).alias("base_sha256"),
                        secrets.listed(spans).alias("spans"))


@register("op12_source_divergence", divergence.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and the terms that each source uses most beyond its language."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@register("op11_ranked_search", ranked_search.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
