"""B and C: string cleaning, type coercion, packed-row unpacking, row filters.

Everything is a projection or filter except two steps:
* the IQR fence (C4) needs two exact quartiles of the price column, found by
  ``exact_quantiles`` (a few small aggregates, no single-task merge);
* keep-first dedupe (C7) is an aggregate ``min_by(row, _ord)`` per key, which
  combines map-side, so a hot (customer, product) key cannot pile up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions.quantile import exact_quantiles
from .schema import check_kind_columns

# ── Fixed values (must equal the reference's) ───────────────────────────────
PACKED_COLUMNS = ["customer_id", "transaction_id", "user_name", "review_title", "review_content"]
STRING_COLUMNS = ["customer_id", "product_id", "product_name", "user_name", "review_title",
                  "review_content", "transaction_id", "img_link", "product_link"]
NEEDED_COLUMNS = {"transactional": ["customer_id", "date", "price", "quantity"], "review": ["customer_id", "product_id"],
                  "catalog": ["product_id", "price"]}
NUMERIC_COLUMNS = ["price", "actual_price", "discount_pct", "rating", "quantity"]
# ─────────────────────────────────────────────────────────────────────────────


def with_order(df: DataFrame, col: str = "_ord") -> DataFrame:
    """Add an input-order key when the source has none (no shuffle, no global sort)."""
    if col in df.columns:
        return df
    return df.withColumn(col, F.monotonically_increasing_id())


# ── B1–B5 ───────────────────────────────────────────────────────────────────

def clean_string_formats(df: DataFrame) -> DataFrame:
    """Currency, percent, thousands, rating text and category hierarchy → plain text."""
    cols = set(df.columns)
    repl = {}
    for c in ("price", "actual_price"):
        if c in cols and dict(df.dtypes)[c] == "string":
            repl[c] = F.trim(T.strip_currency(c))
    if "discount_pct" in cols and dict(df.dtypes)["discount_pct"] == "string":
        repl["discount_pct"] = T.strip_percent("discount_pct")
    if "quantity" in cols and dict(df.dtypes)["quantity"] == "string":
        repl["quantity"] = T.strip_thousands("quantity")
    if "rating" in cols and dict(df.dtypes)["rating"] == "string":
        repl["rating"] = T.extract_rating("rating")
    if "category" in cols:
        repl["category"] = T.top_category("category")
    return df.withColumns(repl) if repl else df


# ── B6–B8 ───────────────────────────────────────────────────────────────────

def date_rejects(raw: DataFrame, typed: DataFrame, col: str = "date") -> DataFrame:
    """C8 for B8: (date_values, date_rejected), of the dates given as text how many no timestamp came of.

    ``typed`` is ``coerce_types`` of ``raw``'s rows; only the texts' and the timestamps' numbers are compared.
    """
    text = F.trim(F.col(col).cast("string"))
    given = raw.agg(F.count_if(text.isNotNull() & (text != "")).alias("date_values"))
    read = typed.agg(F.count(col).alias("read"))
    return given.select("date_values", (F.col("date_values") - read.scalar()).alias("date_rejected"))


def coerce_types(df: DataFrame, date_format: str | None = "auto") -> DataFrame:
    """Ids/text → trimmed string, numbers → double (bad → null), date → timestamp.

    ``date_format='auto'`` takes the format of ``DATE_FORMATS`` that rejects the fewest
    values of the column; ``numeric.choose_date_format`` gives the number rejected.
    """
    types = dict(df.dtypes)
    repl = {}
    for c in STRING_COLUMNS:
        if c in types:
            repl[c] = T.to_text(c)
    for c in NUMERIC_COLUMNS:
        if c in types:
            repl[c] = N.numeric_or_number(c, types[c])
    if "date" in types:
        if types["date"].startswith("timestamp") or types["date"] == "date":
            repl["date"] = F.col("date").cast("timestamp")
        else:
            fmt = N.detect_date_format(df, "date") if date_format == "auto" else date_format
            repl["date"] = N.parse_timestamp("date", fmt)
    return df.withColumns(repl) if repl else df


# ── C1: packed rows ─────────────────────────────────────────────────────────

def unpack_packed_rows(df: DataFrame) -> DataFrame:
    """One row per packed customer: comma lists split, aligned by position.

    The anchor list is customer_id (else the first packed column with a value);
    other packed columns take the value at the same position (null past their
    end); product-level columns repeat. Rows without any packed value go.
    """
    packed = [c for c in PACKED_COLUMNS if c in df.columns]
    if not packed:
        return df
    arrs = {}
    for c in packed:
        t = F.trim(F.col(c).cast("string"))
        valid = t.isNotNull() & ~t.isin("", "nan", "None")
        arrs[c] = F.when(valid, F.transform(F.split(F.col(c).cast("string"), ","), lambda x: F.trim(x)))
    tmp = df.withColumns({f"_arr_{c}": a for c, a in arrs.items()})
    anchor = F.coalesce(*[F.col(f"_arr_{c}") for c in packed])
    tmp = tmp.withColumn("_anchor", anchor).filter(F.col("_anchor").isNotNull())
    tmp = tmp.select("*", F.posexplode("_anchor").alias("_pos", "_val"))
    out = tmp.withColumns({c: F.get(F.col(f"_arr_{c}"), F.col("_pos")) for c in packed})
    if "_ord" in df.columns:
        out = out.withColumn("_ord", F.struct(F.col("_ord").alias("row"), F.col("_pos").alias("pos")))
    return out.drop(*[f"_arr_{c}" for c in packed], "_anchor", "_pos", "_val")


# ── C2–C7 ───────────────────────────────────────────────────────────────────

def drop_missing(df: DataFrame, kind: str) -> DataFrame:
    """Drop rows missing a column the kind needs."""
    check_kind_columns(df.columns, kind)
    return df.dropna(subset=NEEDED_COLUMNS[kind])


def positive_filter(df: DataFrame, kind: str) -> DataFrame:
    """Quantity > 0 and price > 0 (catalog: price > 0)."""
    if kind == "transactional":
        return df.filter((F.col("quantity") > 0) & (F.col("price") > 0))
    if kind == "catalog":
        return df.filter(F.col("price") > 0)
    return df


def iqr_fences(df: DataFrame, col: str = "price", k: float = 3.0) -> tuple[float, float] | None:
    """Exact quartile fences [Q1 − k·IQR, Q3 + k·IQR] (linear interpolation)."""
    q1, q3 = exact_quantiles(df, col, [0.25, 0.75])
    if q1 is None:
        return None
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def iqr_filter(df: DataFrame, col: str = "price", k: float = 3.0) -> DataFrame:
    """C4: keep rows whose value lies inside the fences, bounds included."""
    fences = iqr_fences(df, col, k)
    if fences is None:
        return df.filter(F.lit(False))
    lo, hi = fences
    return df.filter(F.col(col).between(F.lit(lo), F.lit(hi)))


def placeholder_filter(df: DataFrame, cols=("customer_id", "product_id")) -> DataFrame:
    """Drop ids that are placeholder text."""
    cond = F.lit(True)
    for c in cols:
        if c in df.columns:
            cond = cond & ~F.col(c).isin(*T.ID_PLACEHOLDERS)
    return df.filter(cond)


def rating_range_filter(df: DataFrame) -> DataFrame:
    """Rating within 1..5 or missing."""
    if "rating" not in df.columns:
        return df
    return df.filter(F.col("rating").between(1, 5) | F.col("rating").isNull())


def dedupe_keep_first(df: DataFrame, keys=("customer_id", "product_id"), order_col: str = "_ord") -> DataFrame:
    """First row per key in input order, as a map-side-combinable aggregate."""
    df = with_order(df, order_col)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order_col)).alias("_first"))
    return agg.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def clean_rows(df: DataFrame, kind: str, iqr_k: float = 3.0) -> DataFrame:
    """C2–C7 in the reference's order for each dataset kind."""
    df = drop_missing(df, kind)
    if kind == "transactional":
        return iqr_filter(positive_filter(df, kind), "price", iqr_k)
    if kind == "review":
        df = placeholder_filter(df)
        df = dedupe_keep_first(df)
        return rating_range_filter(df)
    return positive_filter(df, kind)


def removed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in, rows kept, rows removed (one row)."""
    b = before.agg(F.count(F.lit(1)).alias("rows_in"))
    a = after.agg(F.count(F.lit(1)).alias("rows_kept"))
    return b.select("rows_in", a.scalar().alias("rows_kept")) \
            .withColumn("rows_removed", F.col("rows_in") - F.col("rows_kept"))


def reject_counts(df: DataFrame, kind: str) -> DataFrame:
    """C8 per rule for transactional data: one aggregate of count_if's before the fence."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("customer_id").isNull()).alias("missing_customer"),
        F.count_if(F.col("date").isNull()).alias("missing_date"),
        F.count_if(F.col("price").isNull()).alias("missing_price"),
        F.count_if(F.col("quantity").isNull()).alias("missing_quantity"),
        F.count_if(F.col("quantity") <= 0).alias("non_positive_quantity"),
        F.count_if(F.col("price") <= 0).alias("non_positive_price"),
    )
