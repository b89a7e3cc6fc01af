"""Registered queries for section G (basket rules) on the test data.

Brand baskets (25 brands, ~4 lines per order) carry frequent pairs at the
default support, so they exercise itemsets and rules; product-name baskets run
the full mode ladder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as D
from ..operators import rules as G
from . import prepare
from .registry import register
from .sql import MASK_RULES, first_rung, mask_itemsets, mask_ladder, with_catalog, with_reviews, with_sales

REVIEW_BASKETS = """
, rb AS (SELECT list_sort(list(DISTINCT category)) AS items FROM rsales WHERE category IS NOT NULL
         GROUP BY customer_id HAVING count(DISTINCT category) > 1)
"""
_MODE = f"CASE WHEN (SELECT count(*) FROM rb) >= {G.PRODUCT_MODE_BASKETS} THEN 'product' ELSE 'category' END"
LADDER = first_rung("rb", "rw") + mask_ladder("rw", G.MIN_SUPPORT, G.MIN_CONFIDENCE, mode=_MODE)

BRAND_TX = """
, bp AS (SELECT DISTINCT customer_id, transaction_id, brand FROM sales WHERE brand IS NOT NULL),
bl AS (SELECT customer_id, transaction_id, list_sort(list(brand)) AS items FROM bp
       GROUP BY customer_id, transaction_id HAVING count(*) > 1),
tx AS (SELECT items FROM bl),
n AS (SELECT count(*) AS n FROM tx),
s1 AS (SELECT i, count(*) AS freq FROM (SELECT unnest(items) AS i FROM tx) GROUP BY i),
pr AS (SELECT a.i AS i1, b.i AS i2, count(*) AS freq
       FROM (SELECT customer_id || '/' || transaction_id AS r, unnest(items) AS i FROM bl) a
       JOIN (SELECT customer_id || '/' || transaction_id AS r, unnest(items) AS i FROM bl) b
         ON a.r = b.r AND a.i < b.i
       GROUP BY 1, 2),
f1 AS (SELECT i, freq, freq / (SELECT n FROM n) AS support FROM s1 WHERE freq / (SELECT n FROM n) >= 0.02),
f2 AS (SELECT i1, i2, freq, freq / (SELECT n FROM n) AS support FROM pr WHERE freq / (SELECT n FROM n) >= 0.02)
"""


def _brand_tx(spark, sf_dir):
    return G.normalise_baskets(prepare.baskets(spark, sf_dir, "brand"))


@register("rules_itemsets_small", with_sales(BRAND_TX + """
SELECT i AS items, CAST(freq AS BIGINT) AS freq, round(support, 6) AS support FROM f1
UNION ALL
SELECT i1 || '|' || i2 AS items, CAST(freq AS BIGINT) AS freq, round(support, 6) AS support FROM f2
"""))
def rules_itemsets_small(spark, sf_dir):
    """G1 + G2: frequent itemsets of brands at support 0.02 (brands at that support go up to pairs)."""
    return _itemset_rows(prepare.itemsets(spark, sf_dir, "brand", 0.02))


def _itemset_rows(its):
    return its.select(F.array_join("items", "|").alias("items"), "freq", F.round("support", 6).alias("support"))


def _rule_rows(rules):
    return G.round_rules(rules).select(F.array_join("antecedents", "|").alias("antecedents"),
                                       F.array_join("consequents", "|").alias("consequents"),
                                       "support", "confidence", "lift")


def _mined_rows(res):
    return res.rules.select(F.array_join("antecedents", "|").alias("antecedents"),
                            F.array_join("consequents", "|").alias("consequents"), "support", "confidence", "lift", "rank",
                            "mode", F.lit(res.total_found).cast("bigint").alias("total_found"),
                            F.lit(res.min_support).cast("double").alias("min_support"))


TYPE_BASKETS = """
, tb AS (SELECT list_sort(list(DISTINCT category)) AS items FROM sales WHERE category IS NOT NULL
         GROUP BY customer_id, transaction_id HAVING count(DISTINCT category) > 1)
"""


@register("rules_itemsets_all", with_sales(TYPE_BASKETS + mask_itemsets("tb", "0.02::DOUBLE") + """
SELECT array_to_string(items, '|') AS items, freq, round(support, 6) AS support FROM fi
"""))
def rules_itemsets_all(spark, sf_dir):
    """Frequent itemsets of every size over the baskets of part types."""
    return _itemset_rows(prepare.itemsets(spark, sf_dir, "category", 0.02))


@register("rules_itemsets_pruned", with_sales(TYPE_BASKETS + mask_itemsets("tb", "0.02::DOUBLE") + """
SELECT array_to_string(items, '|') AS items, freq, round(support, 6) AS support FROM fi
"""))
def rules_itemsets_pruned(spark, sf_dir):
    """D7 + G2: the same itemsets from baskets that were put together after their rare items had gone."""
    tx = D.build_pruned_baskets(prepare.clean_sales(spark, sf_dir), 0.02, label="category")
    return _itemset_rows(G.frequent_itemsets(tx, 0.02))


@register("rules_all_splits", with_sales(TYPE_BASKETS + mask_itemsets("tb", "0.02::DOUBLE") + MASK_RULES + """
SELECT array_to_string(ai, '|') AS antecedents, array_to_string(ci, '|') AS consequents, round(support, 4) AS support,
       round(confidence, 4) AS confidence, round(lift, 4) AS lift
FROM ru
"""))
def rules_all_splits(spark, sf_dir):
    """Every antecedent → consequent split of every itemset, several items on either side."""
    return _rule_rows(G.generate_rules(prepare.itemsets(spark, sf_dir, "category", 0.02)))


@register("rules_support_relaxed", with_reviews(REVIEW_BASKETS + mask_ladder("rb", 1.01, 0.3)))
def rules_support_relaxed(spark, sf_dir):
    """A support above every item's is halved until an item reaches it."""
    return _mined_rows(G.mine_rules(D.build_baskets(prepare.review_sales(spark, sf_dir), "review"), 1.01))


@register("review_rules_ladder", with_reviews(REVIEW_BASKETS + LADDER))
def review_rules_ladder(spark, sf_dir):
    """G6 on review-kind baskets: product mode over the categories of a customer."""
    s = prepare.review_sales(spark, sf_dir)
    return _mined_rows(G.run_rules(D.build_baskets(s, "review"), baskets_all=D.build_baskets(s, "review", keep_singles=True)))


@register("catalog_rules_ladder", with_catalog("""
, rb AS (SELECT list_sort(list(DISTINCT category)) AS items FROM cclean WHERE category IS NOT NULL
         GROUP BY customer_id HAVING count(DISTINCT category) > 1)
""" + LADDER))
def catalog_rules_ladder(spark, sf_dir):
    """G6 on catalog-kind baskets."""
    s = prepare.catalog_sales(spark, sf_dir)
    return _mined_rows(G.run_rules(D.build_baskets(s, "catalog"), baskets_all=D.build_baskets(s, "catalog", keep_singles=True)))


@register("review_popular_items", with_reviews("""
, b AS (SELECT DISTINCT customer_id, category FROM rsales WHERE category IS NOT NULL),
n AS (SELECT count(DISTINCT customer_id) AS n FROM b),
c AS (SELECT category, count(*) AS k FROM b GROUP BY 1)
SELECT category AS consequents, round(k / n, 4) AS support, row_number() OVER (ORDER BY k DESC, category) AS rank,
       'popular_fallback' AS mode, k AS purchase_count
FROM c, n
"""))
def review_popular_items(spark, sf_dir):
    """G8 for review data: items by the baskets that hold them, single-item baskets included."""
    every = D.build_baskets(prepare.review_sales(spark, sf_dir), "review", keep_singles=True)
    return G.popular_in_baskets(every).select(F.array_join("consequents", "|").alias("consequents"), "support", "rank", "mode",
                                              "purchase_count")


PAIR_RULES = """
, pr_rules AS (
  SELECT f2.i1 AS a, f2.i2 AS c, f2.support, f2.support / fa.support AS confidence,
         f2.support / fa.support / fc.support AS lift
  FROM f2 JOIN f1 fa ON fa.i = f2.i1 JOIN f1 fc ON fc.i = f2.i2
  UNION ALL
  SELECT f2.i2 AS a, f2.i1 AS c, f2.support, f2.support / fa.support AS confidence,
         f2.support / fa.support / fc.support AS lift
  FROM f2 JOIN f1 fa ON fa.i = f2.i2 JOIN f1 fc ON fc.i = f2.i1)
"""


@register("rules_pairs", with_sales(BRAND_TX + PAIR_RULES + """
SELECT a AS antecedents, c AS consequents, round(support, 4) AS support,
       round(confidence, 4) AS confidence, round(lift, 4) AS lift
FROM pr_rules WHERE confidence >= 0.15
"""))
def rules_pairs(spark, sf_dir):
    """G3 + G4: brand rules at the relaxed confidence (0.3 × ½) and their metrics."""
    its = prepare.itemsets(spark, sf_dir, "brand", 0.02)
    return _rule_rows(G.generate_rules(its).filter(F.col("confidence") >= 0.15))


@register("rules_search", with_sales(BRAND_TX + PAIR_RULES + """
SELECT a AS antecedents, c AS consequents, round(support, 4) AS support,
       round(confidence, 4) AS confidence, round(lift, 4) AS lift
FROM pr_rules WHERE confidence >= 0.15 AND lower(a || ' ' || c) LIKE '%brand#1%'
"""))
def rules_search(spark, sf_dir):
    """Rules whose items mention 'brand#1' (case-blind), confidence ≥ 0.15."""
    its = prepare.itemsets(spark, sf_dir, "brand", 0.02)
    rules = G.generate_rules(its).filter(F.col("confidence") >= 0.15)
    return _rule_rows(G.search_rules(G.round_rules(rules), "Brand#1"))


@register("rules_all_brand", with_sales(BRAND_TX + PAIR_RULES + """
, kept AS (SELECT * FROM pr_rules WHERE confidence >= 0.3),
lvl AS (SELECT CASE WHEN (SELECT count(*) FROM kept) > 0 THEN 0.3 ELSE 0.15 END AS c),
sel AS (SELECT * FROM pr_rules WHERE confidence >= (SELECT c FROM lvl)),
rk AS (SELECT *, row_number() OVER (ORDER BY lift DESC, confidence DESC, support DESC, a, c) AS rank FROM sel)
SELECT a AS antecedents, c AS consequents, round(support, 4) AS support, round(confidence, 4) AS confidence,
       round(lift, 4) AS lift, rank, 'product' AS mode, (SELECT count(*) FROM sel) AS total_found
FROM rk WHERE rank <= 20
"""))
def rules_all_brand(spark, sf_dir):
    """G3 + G4 + G5: top 20 by lift on brand baskets, confidence relaxed if need be."""
    res = G.mine_rules(_brand_tx(spark, sf_dir), 0.02, 0.3, 20, "product")
    r = res.rules
    return r.select(F.array_join("antecedents", "|").alias("antecedents"),
                    F.array_join("consequents", "|").alias("consequents"), "support", "confidence", "lift",
                    "rank", "mode", F.lit(res.total_found).cast("bigint").alias("total_found"))


WORD_BASKETS = """
, pairs AS (SELECT DISTINCT customer_id, transaction_id, product_name FROM sales WHERE product_name IS NOT NULL),
b AS (SELECT customer_id, transaction_id, count(*) AS n FROM sales GROUP BY 1, 2),
w AS (SELECT DISTINCT p.customer_id, p.transaction_id, lower(regexp_extract(p.product_name, '^\\s*(\\S+)', 1)) AS word
      FROM pairs p JOIN b USING (customer_id, transaction_id) WHERE b.n > 1),
wb AS (SELECT list_sort(list(word)) AS items FROM w WHERE word <> '' GROUP BY customer_id, transaction_id HAVING count(*) > 1)
"""


@register("rules_first_words", with_sales(WORD_BASKETS + mask_ladder("wb", G.MIN_SUPPORT, G.MIN_CONFIDENCE, mode="'category'")))
def rules_first_words(spark, sf_dir):
    """G2–G5 + G7: rules between the first words of product names, the rung that product baskets fall to at scale."""
    words = G.first_word_baskets(prepare.baskets(spark, sf_dir, "product_name"))
    return _mined_rows(G.mine_rules(words, mode="category"))


@register("rules_ladder_products")
def rules_ladder_products(spark, sf_dir):
    """G5 + G6: the mode ladder on product-name baskets."""
    s = prepare.clean_sales(spark, sf_dir, columns=("transaction_id", "product_name"))
    return _mined_rows(G.run_rules(prepare.baskets(spark, sf_dir, "product_name"), s, "product_name"))


@register("first_word_baskets", with_sales("""
, pairs AS (SELECT DISTINCT customer_id, transaction_id, product_name FROM sales WHERE product_name IS NOT NULL),
b AS (SELECT customer_id, transaction_id, count(*) AS n FROM sales GROUP BY 1, 2),
w AS (SELECT DISTINCT p.customer_id, p.transaction_id,
             lower(regexp_extract(p.product_name, '^\\s*(\\S+)', 1)) AS word
      FROM pairs p JOIN b USING (customer_id, transaction_id) WHERE b.n > 1)
SELECT customer_id, transaction_id AS basket_key, array_to_string(list_sort(list(word)), '|') AS items
FROM w WHERE word <> '' GROUP BY 1, 2 HAVING count(*) > 1
"""))
def first_word_baskets(spark, sf_dir):
    """First-word category baskets from the multi-line product baskets."""
    b = G.first_word_baskets(D.build_baskets(prepare.clean_sales(spark, sf_dir), "transactional"))
    return b.select("customer_id", "basket_key", F.array_join("items", "|").alias("items"))


@register("popular_items", with_sales("""
, nb AS (SELECT count(*) AS n FROM (SELECT DISTINCT customer_id, transaction_id FROM sales)),
c AS (SELECT product_name AS item, count(*) AS purchase_count FROM sales
      WHERE product_name IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY purchase_count DESC, item) AS rank FROM c)
SELECT item AS consequents, round(purchase_count / (SELECT n FROM nb), 4) AS support,
       round(purchase_count / (SELECT n FROM nb), 4) AS confidence, 1.0::DOUBLE AS lift,
       rank, 'popular_fallback' AS mode, CAST(purchase_count AS BIGINT) AS purchase_count
FROM r WHERE rank <= 20
"""))
def popular_items(spark, sf_dir):
    """Popular items, counted once per line, support over all baskets."""
    p = G.popular_items(prepare.clean_sales(spark, sf_dir), label="product_name", top_n=20)
    return p.drop("antecedents").withColumn("consequents", F.array_join("consequents", "|"))
