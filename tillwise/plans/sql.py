"""Shared DuckDB SQL pieces for the oracle queries (same semantics as the Spark plans)."""

from ..sources.tables import EVENTS_SALES_SQL, SALES_SQL

# Clean transactional sales: null drop, positive filter, exact IQR fence (k=3),
# then revenue / weekday (Mon=0) / month.
_CLEAN_TEMPLATE = """
{name}_raw AS ({src}),
{name}_pos AS (
  SELECT * FROM {name}_raw
  WHERE customer_id IS NOT NULL AND date IS NOT NULL AND price IS NOT NULL
    AND quantity IS NOT NULL AND quantity > 0 AND price > 0),
{name}_q AS (
  SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM {name}_pos),
{name} AS (
  SELECT p.*, p.quantity * p.price AS revenue, isodow(p.date) - 1 AS day_of_week,
         month(p.date) AS month
  FROM {name}_pos p, {name}_q q
  WHERE p.price BETWEEN q.q1 - 3 * (q.q3 - q.q1) AND q.q3 + 3 * (q.q3 - q.q1))
"""

CLEAN_SALES = _CLEAN_TEMPLATE.format(name="sales", src=SALES_SQL)
CLEAN_EVENTS = _CLEAN_TEMPLATE.format(name="ev", src=EVENTS_SALES_SQL)


def with_sales(body: str) -> str:
    """``WITH <clean sales> <body>`` where body may start with more CTEs (', x AS (...)')."""
    body = body.strip()
    if body.startswith(","):
        return "WITH " + CLEAN_SALES + body
    return "WITH " + CLEAN_SALES + "\n" + body


def with_events(body: str) -> str:
    body = body.strip()
    if body.startswith(","):
        return "WITH " + CLEAN_EVENTS + body
    return "WITH " + CLEAN_EVENTS + "\n" + body


def title_sql(expr: str) -> str:
    """Python-style title case in DuckDB (upper after every non-letter)."""
    return (f"array_to_string(list_transform(regexp_extract_all(lower({expr}), '(\\p{{L}}+|\\P{{L}}+)'), "
            f"lambda w: upper(w[1]) || lower(w[2:])), '')")


def _num(x: str) -> str:
    pat = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return f"CASE WHEN regexp_full_match({x}, '{pat}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def _arr(c: str) -> str:
    return (f"CASE WHEN {c} IS NOT NULL AND trim({c}) NOT IN ('', 'nan', 'None') "
            f"THEN list_transform(string_split({c}, ','), lambda x: trim(x)) END")


# Review-kind cleaning of the review-shaped raw rows, in DuckDB.
REVIEW_CTES = f"""
rv_raw AS ({{raw}}),
rv_a AS (SELECT *, {_arr('user_id')} AS a_c, {_arr('review_id')} AS a_t, {_arr('user_name')} AS a_n,
                {_arr('review_title')} AS a_r FROM rv_raw),
rv_b AS (SELECT *, coalesce(a_c, a_t, a_n, a_r) AS anchor FROM rv_a WHERE coalesce(a_c, a_t, a_n, a_r) IS NOT NULL),
rv_u AS (SELECT rv_b.*, unnest(generate_series(0, len(anchor) - 1)) AS pos FROM rv_b),
rv_t AS (
  SELECT trim(a_c[pos + 1]) AS customer_id, trim(a_t[pos + 1]) AS transaction_id, trim(a_n[pos + 1]) AS user_name,
         trim(a_r[pos + 1]) AS review_title, trim(product_id) AS product_id,
         trim(split_part(category, '|', 1)) AS category,
         {_num("trim(regexp_replace(discounted_price, '[₹$€£,\\s]', '', 'g'))")} AS price,
         {_num("trim(regexp_replace(actual_price, '[₹$€£,\\s]', '', 'g'))")} AS actual_price,
         {_num("trim(replace(discount_percentage, '%', ''))")} AS discount_pct,
         {_num("NULLIF(regexp_extract(rating, '(\\d+\\.?\\d*)', 1), '')")} AS rating,
         {_num("trim(replace(rating_count, ',', ''))")} AS quantity,
         o_k, pos
  FROM rv_u),
rv_f AS (SELECT * FROM rv_t WHERE customer_id IS NOT NULL AND product_id IS NOT NULL
           AND customer_id NOT IN ('None', 'nan', '') AND product_id NOT IN ('None', 'nan', '')),
rv_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, product_id ORDER BY o_k, pos) AS rn
                        FROM rv_f) WHERE rn = 1),
rsales AS (SELECT * EXCLUDE (rn), price * coalesce(quantity, 1.0) AS revenue,
                  CASE WHEN actual_price - price < 0 THEN 0.0 ELSE actual_price - price END AS discount_amount
           FROM rv_d WHERE rating BETWEEN 1 AND 5 OR rating IS NULL)
"""


def with_reviews(body: str) -> str:
    from ..sources.review import REVIEW_RAW_SQL
    body = body.strip()
    head = "WITH " + REVIEW_CTES.replace("{raw}", REVIEW_RAW_SQL)
    return head + (body if body.startswith(",") else "\n" + body)


CATALOG_CTES = f"""
cat_raw AS ({{raw}}),
csales AS (
  SELECT trim(buyer_id) AS customer_id, trim(sku) AS product_id,
         trim(split_part(product_category, '|', 1)) AS category,
         {_num("trim(regexp_replace(unit_price, '[₹$€£,\\s]', '', 'g'))")} AS price
  FROM cat_raw),
cclean AS (SELECT *, price AS revenue FROM csales WHERE product_id IS NOT NULL AND price IS NOT NULL AND price > 0)
"""


def with_catalog(body: str) -> str:
    from ..sources.tables import CATALOG_RAW_SQL
    body = body.strip()
    head = "WITH " + CATALOG_CTES.replace("{raw}", CATALOG_RAW_SQL)
    return head + (body if body.startswith(",") else "\n" + body)


def mask_itemsets(baskets: str, min_support: str) -> str:
    """CTEs ``bn``, ``top`` and ``fi``: frequent itemsets of any size over baskets of few distinct items.

    ``baskets`` names a CTE with a list column ``items``; a basket becomes a bit mask, and
    every mask is an itemset whose support is counted over the distinct baskets.
    ``min_support`` may refer to ``top.support``, the support of the best single item.
    """
    return f"""
, br AS (SELECT row_number() OVER () AS r, items FROM {baskets}),
bx AS (SELECT r, unnest(items) AS i FROM br),
ct AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS b FROM (SELECT DISTINCT i FROM bx)),
bm AS (SELECT mask, count(*) AS c FROM (SELECT r, sum(1::BIGINT << b)::BIGINT AS mask FROM bx JOIN ct USING (i) GROUP BY r) GROUP BY mask),
bn AS (SELECT count(*) AS n FROM br),
im AS (SELECT unnest(generate_series(1, (1 << (SELECT count(*) FROM ct)::INT) - 1))::BIGINT AS mask),
nm AS (SELECT mask, list_sort(list(i)) AS items FROM im JOIN ct ON (mask >> b) & 1 = 1 GROUP BY mask),
sp AS (SELECT im.mask, sum(c)::BIGINT AS freq, sum(c)::BIGINT / any_value(n) AS support FROM im JOIN bm ON bm.mask & im.mask = im.mask, bn GROUP BY im.mask),
top AS (SELECT max(support) AS support FROM sp JOIN nm USING (mask) WHERE len(items) = 1),
ms AS (SELECT {min_support} AS s FROM top),
fi AS (SELECT sp.*, items FROM sp JOIN nm USING (mask), ms WHERE support >= s)
"""


MASK_RULES = """
, ru AS (
  SELECT a.items AS ai, c.items AS ci, f.support, f.support / a.support AS confidence, f.support / a.support / c.support AS lift
  FROM fi f JOIN fi a ON a.mask & f.mask = a.mask AND a.mask <> f.mask JOIN fi c ON c.mask = f.mask - a.mask)
"""


def first_rung(baskets: str, out: str) -> str:
    """CTE ``out``: the baskets as they are from 50 on, else their lower-cased first words (the ladder's next rung)."""
    return f"""
, {out} AS (SELECT items FROM (
    SELECT CASE WHEN (SELECT count(*) FROM {baskets}) >= 50 THEN items ELSE
      list_sort(list_distinct(list_transform(items, lambda x: lower(regexp_extract(x, '^\\s*(\\S+)', 1))))) END AS items
    FROM {baskets}) WHERE len(items) > 1)
"""


def mask_ladder(baskets: str, min_support: float, min_confidence: float, top_n: int = 20, mode: str = "'product'") -> str:
    """The mined rules of ``baskets`` (G2–G5): relaxed support and confidence, ranked and cut."""
    support = f"CASE WHEN support >= {min_support} THEN {min_support} WHEN support >= {min_support} * 0.5 THEN {min_support} * 0.5 ELSE {min_support} * 0.25 END"
    return mask_itemsets(baskets, support.replace(f"{min_support}", f"{min_support}::DOUBLE")) + MASK_RULES + f"""
, lv AS (SELECT CASE WHEN count(*) FILTER (confidence >= {min_confidence}) > 0 THEN {min_confidence}::DOUBLE ELSE {min_confidence} * 0.5::DOUBLE END AS c FROM ru),
se AS (SELECT ru.* FROM ru, lv WHERE confidence >= c),
rk AS (SELECT *, row_number() OVER (ORDER BY lift DESC, confidence DESC, support DESC, array_to_string(ai, chr(1)), array_to_string(ci, chr(1))) AS rank FROM se)
SELECT array_to_string(ai, '|') AS antecedents, array_to_string(ci, '|') AS consequents, round(support, 4) AS support,
       round(confidence, 4) AS confidence, round(lift, 4) AS lift, rank, {mode} AS mode,
       (SELECT count(*) FROM se) AS total_found, (SELECT s FROM ms) AS min_support
FROM rk WHERE rank <= {top_n}
"""
