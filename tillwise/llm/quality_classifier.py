"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes.

A logistic regression on text measures, fitted to the labelled documents, gives each
document a probability of good quality. Those (the label itself where there is one) are summed by
host (the source) and by path below it (source and language). Beta priors are fitted by
moments: the path's rate is shrunk to its host's posterior and the host's to the overall rate, by as
much as the spread between hosts (paths) supports, so that a site of a few documents says
little. A document's log odds are its own evidence, the classifier's log odds less
those of the overall rate, plus the log odds of its path's posterior.

Cases: null and empty texts have zero measures and are scored like any other; a null source or
language is a site of its own; a label is used once per labelled doc_id (its mean, if
labels repeat), null labels are ignored; without labels of both kinds the evidence is
the share of measures within the rules' limits; repeated rows give equal rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_shared

KEEP_AT = 0.5
EVIDENCE_CLIP = 8.0
REGULARISATION = 0.001
STRENGTH_RANGE = (2.0, 1e4)
FEATURES = ("log_words", "word_chars", "symbols", "capitals", "distinct_words", "distinct_lines", "ends", "digits", "longest")
SYMBOLS = "#*$%&|<>{}[]=_~^"


def measure(text: str | None) -> tuple[float, ...]:
    """The FEATURES of one whole text."""
    words = (text or "").split()
    if not words:
        return (0.0,) * len(FEATURES)
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    return (n.bit_length() / 8, chars / n / 8, min(2.0, sum(map(text.count, SYMBOLS)) / n),
            sum(len(w) > 1 and w.isupper() for w in words) / n, len(set(words)) / n, len(set(lines)) / len(lines),
            min(2.0, sum(map(text.count, ".!?")) / n), min(2.0, sum(map(text.count, "0123456789")) / n),
            min(4.0, max(map(len, words)) / 32))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, FEATURES)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            got = [measure(t.as_py()) for t in b.column("text")]
            cols = [pa.array([g[i] for g in got], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["doc_id", "source", "lang", *FEATURES])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "lang"))
    return docs.select("doc_id", "source", "lang", "text").mapInArrow(
        run, kinds + ", " + ", ".join(f"{f} double" for f in FEATURES))


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def evidence(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``label`` (null where there is none) and ``p``, the classifier's probability of good quality."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("label")).where("label IS NOT NULL")
    both = write_shared(feats.join(known, "doc_id", "left"), "quality-labelled")
    train = both.where("label IS NOT NULL").withColumn("y", (F.col("label") >= 0.5).cast("double"))
    kinds = train.agg(F.countDistinct("y")).first()[0]
    if kinds < 2:
        within = (F.col("symbols") < 0.2).cast("int") + (F.col("capitals") < 0.4).cast("int") + (F.col("distinct_words") > 0.2).cast("int")
        return both.withColumn("p", (within + 0.5) / 4)
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="x").fit(vector.transform(train))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=REGULARISATION, maxIter=40).fit(
        scaler.transform(vector.transform(train)).select("x", "y"))
    scored = model.transform(scaler.transform(vector.transform(both)))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("raw", "x", "rawPrediction", "probability", "prediction")


def _strength(n: str, rate: Column, centre: Column, df: DataFrame) -> float:
    """Prior weight, in documents, of ``centre`` for groups of ``n`` documents with ``rate``, by moments."""
    row = df.agg(F.sum(n), F.sum(F.col(n) * F.pow(rate - centre, 2)), F.sum(F.col(n) * centre * (1 - centre)),
                 F.sum(centre * (1 - centre))).first()
    if not row[0]:
        return STRENGTH_RANGE[1]
    between = max((row[1] - row[3]) / row[0], 1e-9)
    return min(max(row[2] / row[0] / between - 1, STRENGTH_RANGE[0]), STRENGTH_RANGE[1])


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """((source, lang, n_docs, host_rate, site_rate), overall rate)."""
    good = F.coalesce("label", "p")
    paths = write_shared(scored.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(good).alias("s")), "quality-paths")
    hosts = paths.groupBy("source").agg(F.sum("n").alias("h_n"), F.sum("s").alias("h_s"))
    n, s = hosts.agg(F.sum("h_n"), F.sum("h_s")).first()
    overall = min(max((s or 0.0) / n if n else 0.5, 0.01), 0.99)
    k = _strength("h_n", F.col("h_s") / F.col("h_n"), F.lit(overall), hosts)
    hosts = hosts.select(F.col("source").alias("h_source"),
                         ((F.col("h_s") + F.lit(k * overall)) / (F.col("h_n") + F.lit(k))).alias("host_rate"))
    both = write_shared(paths.join(hosts, F.col("source").eqNullSafe(F.col("h_source"))).drop("h_source"), "quality-sites")
    k = _strength("n", F.col("s") / F.col("n"), F.col("host_rate"), both)
    rate = (F.col("s") + F.lit(k) * F.col("host_rate")) / (F.col("n") + F.lit(k))
    return both.select("source", "lang", F.col("n").alias("n_docs"), "host_rate",
                       F.least(F.greatest(rate, F.lit(0.01)), F.lit(0.99)).alias("site_rate")), overall


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, p (document alone), host_rate, site_rate, posterior, kept."""
    scored = write_shared(evidence(write_shared(features(docs), "quality-features"), labels)
                          .select("doc_id", "source", "lang", "label", "p"), "quality-scored")
    sites, overall = site_posteriors(scored)
    sites = sites.select(F.col("source").alias("s_source"), F.col("lang").alias("s_lang"), "host_rate", "site_rate")
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    own = F.least(F.greatest(_log_odds(p) - _log_odds(F.lit(overall)), F.lit(-EVIDENCE_CLIP)), F.lit(EVIDENCE_CLIP))
    posterior = 1 / (1 + F.exp(-(own + _log_odds(F.col("site_rate")))))
    return (scored.join(sites, F.col("source").eqNullSafe(F.col("s_source")) & F.col("lang").eqNullSafe(F.col("s_lang")))
            .select("doc_id", "p", "host_rate", "site_rate", posterior.alias("posterior"))
            .withColumn("kept", F.col("posterior") >= keep_at))
