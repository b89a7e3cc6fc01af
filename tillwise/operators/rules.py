"""G: basket rules — frequent itemsets, every antecedent/consequent split,
threshold relaxation, the mining-mode ladder, popular items, rule search.

Frequent itemsets come from ``pyspark.ml.fpm.FPGrowth`` (parallel FP-growth:
items are hash-partitioned into groups and each group's conditional trees are
mined on executors, so no basket list ever goes through the driver). Its trees
take only the items of a basket that make a frequent pair there: single items and
pairs are plain counts, and every larger itemset is made of frequent pairs. Spark's
own rule generator only emits single-item consequents, so rules are built here
from the itemset table: each itemset of size m explodes into its 2^m − 2
splits by bit masks, and the antecedent / consequent supports are looked up by
joining back on the sorted item arrays (downward closure guarantees a hit).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# ── Fixed values (must equal the reference's defaults) ──────────────────────
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.3
TOP_N = 20
SUPPORT_STEPS = [1.0, 0.5, 0.25]
CONFIDENCE_STEPS = [1.0, 0.5]
MIN_BASKETS = 10           # below this no mining is attempted
PRODUCT_MODE_BASKETS = 50  # product mode needs this many baskets of mean size ≥ 2
# ─────────────────────────────────────────────────────────────────────────────

#: Baskets whose trees one task of the FP-growth holds.
BASKETS_PER_TASK = 50_000
#: Up to so many frequent items their pairs are counted first. Their number goes by basket size over support, not by baskets.
PAIR_ITEMS = 1_000


def normalise_baskets(baskets: DataFrame, items_col: str = "items") -> DataFrame:
    """G1: distinct items per basket, baskets with more than one item."""
    out = baskets.withColumn("items", F.array_sort(F.array_distinct(F.col(items_col))))
    return out.filter(F.size("items") > 1)


def first_word_baskets(baskets: DataFrame) -> DataFrame:
    """Lower-cased first word of every item, distinct, more than one left."""
    words = F.filter(F.transform("items", lambda x: T.first_word_lower(x)), lambda w: w != "")
    out = baskets.withColumn("items", F.array_sort(F.array_distinct(words)))
    return out.filter(F.size("items") > 1)


def _paired(tx: DataFrame, items: list, support: Column, min_support: float) -> DataFrame:
    """``tx`` with the items of each basket that are in a frequent pair with another one there; baskets without one go.

    ``items`` are the frequent ones. An itemset of two or more that is frequent keeps every basket it is in, any other gets no new one.
    """
    first = tx.select("items", F.posexplode("items").alias("at", "a")).where(F.col("a").isin(items))
    both = first.select("a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b")).where(F.col("b").isin(items))
    pairs = (both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("freq"))
             .where(support >= F.lit(min_support)).select("a", "b").collect())  # PAIR_ITEMS squared at most, fewer by far
    others: dict = {}
    for a, b in pairs:
        others.setdefault(a, []).append(b)
        others.setdefault(b, []).append(a)
    if not others:
        return tx.where("false")
    kind = tx.schema["items"].dataType.elementType.simpleString()
    table = tx.sparkSession.createDataFrame([(list(others.items()),)], f"m array<struct<item:{kind},others:array<{kind}>>>")
    known = tx.crossJoin(F.broadcast(table.select(F.map_from_entries("m").alias("others"))))  # one row
    return (known.select(F.filter("items", lambda x: F.arrays_overlap(F.element_at("others", x), F.col("items"))).alias("items"))
            .where(F.size("items") > 1))


def frequent_itemsets(tx: DataFrame, min_support: float, num_partitions: int | None = None) -> DataFrame:
    """(items sorted, freq, support) for every itemset with support ≥ min_support."""
    # item groups of the parallel FP-growth: at least one per core, else the
    # conditional trees are mined by however few tasks the baskets arrived in
    spark = tx.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no local SparkContext (Spark Connect)
        cores = 8
    parts = num_partitions or max(cores, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    n = tx.count()
    support = F.col("freq") / F.lit(n)
    counts = tx.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).cast("bigint").alias("freq"))
    singles = counts.where(support >= F.lit(min_support)).select(F.array("item").alias("items"), "freq", support.alias("support"))
    few = singles.limit(PAIR_ITEMS + 1).collect()
    baskets, kept = tx.select("items"), n
    paired = len(few) <= PAIR_ITEMS and all(r["items"][0] is not None for r in few)
    if paired:
        singles = spark.createDataFrame(few, singles.schema)
        baskets = (_paired(baskets, [r["items"][0] for r in few], support, min_support) if few else baskets.where("false")).persist()
        kept = baskets.count()
        if not kept:
            baskets.unpersist()
            return singles
    # FP-growth keeps freq >= ceil(minSupport·n); a hair lower bound plus the exact
    # support >= min_support filter keeps itemsets sitting exactly on the threshold.
    least = min(1.0, max((min_support - 1e-9) * n / max(kept, 1), 1e-12))
    fp = FPGrowth(itemsCol="items", minSupport=least, minConfidence=1.0).setNumPartitions(parts)
    # a task holds the trees of all its baskets, so the baskets of a task are bounded, however few files they come from
    model = fp.fit(baskets.repartition(max(cores, math.ceil(kept / BASKETS_PER_TASK))))
    if paired:
        baskets.unpersist()  # the fit has dealt them out
    out = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("bigint"), support.alias("support"))
    out = out.filter(F.col("support") >= F.lit(min_support))
    return singles.unionByName(out.where(F.size("items") > 1)) if paired else out


def generate_rules(itemsets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """G3 + G4 metrics: all non-empty antecedent → consequent splits of each itemset, within each ``by`` group.

    ``itemsets`` is read three times (the splits and both sides' supports), so hand
    over a kept table. Output: antecedents, consequents (sorted arrays), support,
    confidence, lift, plus antecedent_support and consequent_support.
    """
    big = itemsets.filter(F.size("items") >= 2)
    masks = F.expr("sequence(1L, shiftleft(1L, size(items)) - 2L)")
    split = big.select(*by, "items", "support", F.explode(masks).alias("mask"))

    def pick(bit_on: bool) -> Column:
        return F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1L) = {1 if bit_on else 0})")

    split = split.select(*by, pick(True).alias("antecedents"), pick(False).alias("consequents"), "support")
    sup = itemsets.select(*by, "items", "support")
    a = sup.select(*by, F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    c = sup.select(*by, F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    r = split.join(a, [*by, "antecedents"]).join(c, [*by, "consequents"])
    conf = F.col("support") / F.col("antecedent_support")
    return r.select(*by, "antecedents", "consequents", "support", conf.alias("confidence"),
                    (conf / F.col("consequent_support")).alias("lift"),
                    "antecedent_support", "consequent_support")


def rank_rules(rules: DataFrame, top_n: int = TOP_N, by: tuple[str, ...] = ()) -> DataFrame:
    """G4 cut: rules ordered by lift (ties: confidence, support, items), rank ≤ top_n in each ``by`` group."""
    w = Window.partitionBy(*by).orderBy(F.col("lift").desc(), F.col("confidence").desc(), F.col("support").desc(),
                       F.array_join("antecedents", "\u0001"), F.array_join("consequents", "\u0001"))
    ranked = rules.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= top_n) if top_n else ranked


def round_rules(rules: DataFrame) -> DataFrame:
    return rules.withColumns({c: F.round(c, 4) for c in ("support", "confidence", "lift")})


RULE_SCHEMA = ("antecedents array<string>, consequents array<string>, support double, confidence double, lift double, "
               "rank int, mode string")


@dataclass
class MiningResult:
    rules: DataFrame          # ranked, rounded rules (rank ≤ top_n), with ``mode``
    total_found: int
    mining_mode: str
    min_support: float | None = None
    min_confidence: float | None = None
    kept: list[DataFrame] = field(default_factory=list)   # persisted frames that ``rules`` reads

    def release(self) -> None:
        """Unpersist what the rules were computed from."""
        for df in self.kept:
            df.unpersist()
        self.kept.clear()


def _nothing(df: DataFrame, mode: str, min_support: float | None = None) -> MiningResult:
    return MiningResult(df.sparkSession.createDataFrame([], RULE_SCHEMA), 0, mode, min_support)


def support_level(tx: DataFrame, min_support: float) -> float | None:
    """G5 support step: an itemset list is non-empty exactly when one single
    item reaches the support, so one count per item decides the level."""
    n = tx.count()
    if n == 0:
        return None
    top = tx.select(F.explode("items").alias("i")).groupBy("i").count().agg(F.max("count")).first()[0]
    if top is None:
        return None
    for step in SUPPORT_STEPS:
        s = min_support * step
        if top / n >= s:
            return s
    return None


def mine_rules(tx: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               top_n: int = TOP_N, mode: str = "product") -> MiningResult:
    """G2–G5 on normalised baskets: relaxed support, one FP-growth run, relaxed confidence.

    Baskets, itemsets and rules are each computed once and kept until the result is
    released (or, if nothing is found, until here).
    """
    kept = [normalise_baskets(tx).persist()]
    tx = kept[0]
    result = _nothing(tx, mode)
    s = support_level(tx, min_support) if tx.count() >= MIN_BASKETS else None
    if s is not None:
        kept.append(frequent_itemsets(tx, s).persist())
        kept.append(generate_rules(kept[-1]).persist())
        result = _nothing(tx, mode, s)
        for step in CONFIDENCE_STEPS:
            c = min_confidence * step
            found = kept[-1].filter(F.col("confidence") >= c)
            total = found.count()
            if total > 0:
                ranked = round_rules(rank_rules(found, top_n)).withColumn("mode", F.lit(mode))
                out = ranked.select("antecedents", "consequents", "support", "confidence", "lift", "rank", "mode")
                return MiningResult(out, total, mode, s, c, kept)
    for df in kept:
        df.unpersist()
    return result


def category_share(baskets: DataFrame) -> float:
    """Share of baskets whose items mention a category keyword (Q10)."""
    row = baskets.agg(F.avg(T.has_category_keyword(F.col("items")).cast("double"))).first()
    return row[0] or 0.0


def popular_items(sales: DataFrame, baskets_all: DataFrame | None = None, label: str = "product_name",
                  top_n: int = TOP_N, basket_key: str = "transaction_id") -> DataFrame:
    """Items ranked by line count; support = count / baskets (singles included, Q5)."""
    n_baskets = (baskets_all.select(F.count(F.lit(1))).scalar() if baskets_all is not None else
                 sales.select(F.count_distinct("customer_id", basket_key)).scalar())
    counts = sales.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("item")) \
                  .agg(F.count(F.lit(1)).cast("bigint").alias("purchase_count"))
    return _popular(counts, n_baskets, top_n)


def _popular(counts: DataFrame, n_baskets: Column, top_n: int) -> DataFrame:
    w = Window.orderBy(F.col("purchase_count").desc(), F.col("item"))
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    sup = F.round(F.col("purchase_count") / n_baskets, 4)
    return top.select(F.array().cast("array<string>").alias("antecedents"), F.array("item").alias("consequents"),
                      sup.alias("support"), sup.alias("confidence"), F.lit(1.0).alias("lift"), "rank",
                      F.lit("popular_fallback").alias("mode"), "purchase_count")


def popular_in_baskets(baskets: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """G8 without sales lines: items ranked by the baskets that hold them, support over all ``baskets``."""
    n = baskets.select(F.count(F.lit(1))).scalar()
    lines = baskets.select(F.explode("items").alias("item"))
    return _popular(lines.groupBy("item").agg(F.count(F.lit(1)).cast("bigint").alias("purchase_count")), n, top_n)


def run_rules(baskets: DataFrame, sales: DataFrame | None = None, label: str = "product_name",
              min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
              top_n: int = TOP_N, baskets_all: DataFrame | None = None) -> MiningResult:
    """G6 ladder: product → category → first-word category → relaxed product → popular items.

    ``baskets`` are the multi-line baskets (D7/D8 output, ``items`` + ``n_lines``). The
    last rung counts lines of ``sales`` where that is given (transactional data), else
    the items of ``baskets_all``, all baskets with the single-item ones (any other kind).
    """
    tx = baskets.filter(F.col("n_lines") > 1) if "n_lines" in baskets.columns else baskets
    stats = tx.agg(F.count(F.lit(1)).alias("n"), F.avg("n_lines" if "n_lines" in tx.columns
                                                         else F.size("items")).alias("avg")).first()
    n, avg = stats["n"], stats["avg"] or 0.0
    if n >= PRODUCT_MODE_BASKETS and avg >= 2:
        res = mine_rules(tx, min_support, min_confidence, top_n, "product")
        if res.total_found > 0:
            return res
    if n > 0 and category_share(tx) >= 0.5:
        res = mine_rules(tx, min_support, min_confidence, top_n, "category")
        if res.total_found > 0:
            return res
    words = first_word_baskets(tx)
    if words.limit(MIN_BASKETS).count() >= MIN_BASKETS:
        res = mine_rules(words, min_support, min_confidence, top_n, "category")
        if res.total_found > 0:
            return res
    if n >= MIN_BASKETS:
        res = mine_rules(tx, min_support / 4, min_confidence / 2, top_n, "product")
        if res.total_found > 0:
            return res
    pop = (popular_items(sales, label=label, top_n=top_n) if sales is not None else
           popular_in_baskets(baskets if baskets_all is None else baskets_all, top_n))
    k = pop.count()
    return MiningResult(pop, k, "popular_fallback") if k else _nothing(baskets, "empty")


def search_rules(rules: DataFrame, query: str, sort_by: str = "lift") -> DataFrame:
    """Case-blind substring match over all items, sorted by a metric."""
    text = F.lower(F.concat_ws(" ", F.array_join("antecedents", " "), F.array_join("consequents", " ")))
    out = rules.filter(text.contains(query.lower())) if query else rules
    return out.orderBy(F.col(sort_by).desc(), F.array_join("antecedents", "|"), F.array_join("consequents", "|"))
