"""A: column canonicalisation, fuzzy schema harmonisation, audit, kind, admission.

Column names are metadata: the exact mapping of one frame (A2) is a plan-time
projection. The fuzzy matching (A3) is a Spark job over a table of
``(source_id, position, column_name)`` rows, so thousands of uploaded files are
harmonised in one distributed pass; the alias list is a literal array in the
expression, so no join is involved at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

# ── Fixed values (must equal the reference's) ───────────────────────────────
# Canonical column → accepted aliases, in the reference's order. Where an alias
# appears twice the first occurrence counts.
CANONICAL_ALIASES: dict[str, list[str]] = {
    "customer_id": ["customer_id", "cust_id", "customerid", "client_id", "user_id", "userid",
                    "buyer_id", "customer_name", "customername", "buyer_name"],
    "transaction_id": ["transaction_id", "order_id", "invoice_id", "txn_id", "invoiceno",
                       "invoice_no", "invoice_number", "review_id", "reviewid", "order_number",
                       "order_no"],
    "product_name": ["product_name", "item_name", "product", "item", "description",
                     "product_description", "product_title", "title", "product_name",
                     "item_description"],
    "product_id": ["product_id", "item_id", "sku", "product_code", "stockcode", "stock_code",
                   "asin"],
    "category": ["category", "product_category", "dept", "department", "type", "product_type",
                 "main_category"],
    "quantity": ["quantity", "qty", "units", "count", "rating_count", "num_ratings",
                 "quantity_sold", "units_sold", "quantity_ordered"],
    "price": ["price", "unit_price", "sale_price", "cost", "value", "unitprice", "selling_price",
              "discounted_price", "final_price", "total_sales", "total_revenue", "revenue",
              "amount", "total_amount", "net_sales"],
    "actual_price": ["actual_price", "original_price", "mrp", "list_price", "regular_price",
                     "base_price", "market_price"],
    "discount_pct": ["discount_percentage", "discount_pct", "discount", "discount_percent",
                     "off_percentage"],
    "rating": ["rating", "score", "stars", "review_score", "product_rating", "avg_rating",
               "user_rating"],
    "date": ["date", "purchase_date", "order_date", "transaction_date", "created_at",
             "invoicedate", "invoice_date", "sale_date", "order_timestamp", "order_date",
             "delivery_date", "ship_date"],
    "user_name": ["user_name", "username", "reviewer_name", "reviewer"],
    "review_title": ["review_title", "review_header", "review_summary"],
    "review_content": ["review_content", "review_body", "review_text", "review", "comments",
                       "feedback", "about_product"],
    "img_link": ["img_link", "image_link", "image_url", "img_url"],
    "product_link": ["product_link", "product_url", "item_url", "url", "link"],
    "region": ["country", "region", "state", "city", "province", "location", "area", "territory",
               "zone", "market", "country_code", "geo", "geography", "place", "customer_location",
               "buyer_location"],
}
# Minimum similarity (0..100) for a fuzzy alias match.
FUZZY_THRESHOLD = 80
# The column the pipeline cannot run without, and the useful optional ones.
REQUIRED_COLUMNS = ["customer_id"]
USEFUL_OPTIONAL = ["product_id", "date", "price", "quantity", "rating"]
# ─────────────────────────────────────────────────────────────────────────────


def alias_table() -> list[tuple[str, str]]:
    """(alias, canonical) in lookup order, first occurrence of an alias kept."""
    seen: dict[str, str] = {}
    for canonical, aliases in CANONICAL_ALIASES.items():
        for a in aliases:
            seen.setdefault(a, canonical)
    return list(seen.items())


def normalise_name(name: str) -> str:
    return name.lower().strip().replace(" ", "_").replace("-", "_")


def normalise_name_col(c: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))


# ── A2: exact canonicalisation of one frame ─────────────────────────────────

def canonical_map(columns: list[str]) -> dict[str, str]:
    """raw column → canonical name by exact alias; the first raw column wins."""
    lookup = dict(alias_table())
    used: set[str] = set()
    out: dict[str, str] = {}
    for raw in columns:
        canonical = lookup.get(normalise_name(raw))
        if canonical is not None and canonical not in used:
            out[raw] = canonical
            used.add(canonical)
    return out


def canonicalise(df: DataFrame, fuzzy: bool = False, require_customer: bool = True) -> DataFrame:
    """Rename raw columns to canonical names (one projection, no data read).

    With ``fuzzy=True`` unmatched names go through ``harmonise_schemas`` (a small
    Spark job over the header only). A later column whose canonical is taken
    keeps its raw name; a raw column that clashes with a taken canonical name is
    dropped from the rename so the projection stays unambiguous.
    """
    if fuzzy:
        spark = df.sparkSession
        cols_df = spark.createDataFrame([(0, i, c) for i, c in enumerate(df.columns)],
                                        "source_id int, position int, column_name string")
        rows = harmonise_schemas(cols_df).filter(F.col("canonical").isNotNull()).collect()
        mapping = {r["column_name"]: r["canonical"] for r in rows}
    else:
        mapping = canonical_map(df.columns)
    if require_customer and "customer_id" not in mapping.values():
        raise ValueError(
            "No customer/user id column found; expected a column such as customer_id, "
            f"user_id, buyer_id or userid. Columns: {df.columns}")
    taken = set(mapping.values())
    exprs = []
    for c in df.columns:
        if c in mapping:
            exprs.append(F.col(f"`{c}`").alias(mapping[c]))
        elif c in taken:
            exprs.append(F.col(f"`{c}`").alias(f"{c}_raw"))
        else:
            exprs.append(F.col(f"`{c}`"))
    return df.select(*exprs)


# ── A3: fuzzy harmonisation over many sources ───────────────────────────────

def _lcs_len(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings (row-wise DP)."""
    ca = F.split(a, "")
    cb = F.split(b, "")
    m = F.size(cb)

    def row_step(prev, x):
        def cell(cur, j):
            left = F.get(cur, j - 1)
            up = F.get(prev, j)
            diag = F.get(prev, j - 1)
            val = F.when(x == F.get(cb, j - 1), diag + 1).otherwise(F.greatest(up, left))
            return F.concat(cur, F.array(val))
        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(0)), cell)

    init = F.array_repeat(F.lit(0), m + 1)
    return F.get(F.aggregate(ca, init, row_step), m)


def similarity(a: Column, b: Column) -> Column:
    """Indel similarity 0..100: 200·LCS / (len a + len b)."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * _lcs_len(a, b) / total)


def harmonise_schemas(columns_df: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Map every (source_id, position, column_name) to a canonical name or null.

    Exact alias first, else the best-scoring alias (first in alias order on
    ties) when its score reaches ``threshold``. Within a source the first
    position claiming a canonical keeps it; later ones stay unmapped.
    Output: source_id, position, column_name, canonical, matched_alias, score.
    """
    aliases = alias_table()
    norm = normalise_name_col(F.col("column_name"))
    cand = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(a).alias("alias"), F.lit(c).alias("canonical"))
                     for i, (a, c) in enumerate(aliases)])
    exact = F.filter(cand, lambda s: s["alias"] == norm)
    scored = F.transform(cand, lambda s: F.struct(similarity(norm, s["alias"]).alias("score"),
                                                  (-s["idx"]).alias("neg_idx"),
                                                  s["alias"].alias("alias"),
                                                  s["canonical"].alias("canonical")))
    best = F.array_max(scored)
    pick = F.when(F.size(exact) > 0,
                  F.struct(F.lit(100.0).alias("score"), F.get(exact, 0)["alias"].alias("alias"),
                           F.get(exact, 0)["canonical"].alias("canonical")))\
        .otherwise(F.struct(best["score"].alias("score"), best["alias"].alias("alias"),
                            best["canonical"].alias("canonical")))
    m = columns_df.withColumn("_m", pick)
    hit = F.col("_m.score") >= F.lit(float(threshold))
    m = m.withColumn("_cand", F.when(hit, F.col("_m.canonical")))
    w = Window.partitionBy("source_id", "_cand").orderBy("position")
    m = m.withColumn("_rk", F.when(F.col("_cand").isNotNull(), F.row_number().over(w)))
    return m.select(
        "source_id", "position", "column_name",
        F.when(F.col("_rk") == 1, F.col("_cand")).alias("canonical"),
        F.when(hit, F.col("_m.alias")).alias("matched_alias"),
        F.round(F.col("_m.score"), 1).alias("score"),
    )


# ── A4: audit per source ─────────────────────────────────────────────────────

def schema_audit(mapping_df: DataFrame) -> DataFrame:
    """One row per source: has a customer column, missing optional columns, kind."""
    opt = F.array(*[F.lit(c) for c in USEFUL_OPTIONAL])
    agg = mapping_df.groupBy("source_id").agg(
        F.bool_or(F.col("canonical") == "customer_id").alias("has_customer"),
        F.collect_set("canonical").alias("_found"),
    )
    return agg.select(
        "source_id",
        F.coalesce(F.col("has_customer"), F.lit(False)).alias("has_customer"),
        F.array_sort(F.array_except(opt, F.col("_found"))).alias("missing_optional"),
        dataset_kind_expr(F.col("_found")).alias("dataset_type"),
        F.when(~F.coalesce(F.col("has_customer"), F.lit(False)),
               F.lit("no customer/user id column")).alias("error"),
    )


# ── A5: dataset kind ─────────────────────────────────────────────────────────

def detect_dataset_type(columns: list[str]) -> str:
    """transactional / review / catalog from which canonical columns exist."""
    cols = set(columns)
    if {"date", "quantity", "price"} <= cols:
        return "transactional"
    if "rating" in cols or "transaction_id" in cols:
        return "review"
    if {"price", "product_id"} <= cols:
        return "catalog"
    return "transactional"


def dataset_kind_expr(found: Column) -> Column:
    """Same rule over an array of canonical names (for A3's per-source table)."""
    has = lambda c: F.array_contains(found, c)
    return (F.when(has("date") & has("quantity") & has("price"), "transactional")
             .when(has("rating") | has("transaction_id"), "review")
             .when(has("price") & has("product_id"), "catalog")
             .otherwise("transactional"))


def required_for_kind(kind: str) -> list[str]:
    return {"transactional": ["customer_id", "date", "price", "quantity"],
            "review": ["customer_id", "product_id"],
            "catalog": ["product_id", "price"]}[kind]


def check_kind_columns(columns: list[str], kind: str) -> None:
    """Q9: name the missing columns instead of failing deep inside the cleaning."""
    missing = [c for c in required_for_kind(kind) if c not in columns]
    if missing:
        raise ValueError(f"{kind} data needs columns {missing}; present: {sorted(columns)}")


# ── A6: admission gate ───────────────────────────────────────────────────────

def admission(raw: DataFrame, clean: DataFrame, min_rows: int = 100, min_clean: int = 10,
              unpacked: DataFrame | None = None) -> DataFrame:
    """One row: input rows, rows after cleaning, removed, ok flag and message.

    The gate counts the rows of the upload as it came (``raw``); the rows removed are
    those of ``unpacked``, the rows after packed reviews are taken apart (``raw`` where
    nothing is packed).
    """
    r = raw.agg(F.count(F.lit(1)).alias("input_rows"))
    c = clean.agg(F.count(F.lit(1)).alias("clean_rows"))
    u = (raw if unpacked is None else unpacked).agg(F.count(F.lit(1)).alias("unpacked_rows"))
    j = r.select("input_rows", c.scalar().alias("clean_rows"), u.scalar().alias("unpacked_rows"))
    removed = F.col("unpacked_rows") - F.col("clean_rows")
    return j.select(
        "input_rows", "clean_rows", removed.alias("rows_removed"),
        ((F.col("input_rows") >= min_rows) & (F.col("clean_rows") >= min_clean)).alias("admitted"),
        F.when(F.col("input_rows") < min_rows,
               F.format_string(f"File has %d rows; at least {min_rows} are needed.", F.col("input_rows")))
         .when(F.col("clean_rows") < min_clean,
               F.format_string(f"only %d valid rows are left of the upload, %d were dropped; at least {min_clean} are needed.",
                               F.col("clean_rows"), removed))
         .alias("message"),
    )


def enforce_admission(status: DataFrame) -> None:
    row = status.first()
    if not row["admitted"]:
        raise ValueError(row["message"])
