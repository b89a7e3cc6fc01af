"""Numeric coercion and date helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A plain decimal number, optionally signed / exponent, surrounding blanks allowed.
# Spark's cast also accepts '1.5d' / '1.5f'; the reference's reader does not.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Date formats tried, in order, over the whole column.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd-MM-yy",
    "dd-MM-yyyy",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
]



def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text → double; anything that is not a plain number → null (NaN → null)."""
    txt = _c(c).cast("string")
    return F.when(txt.rlike(NUMBER_PATTERN), F.trim(txt).try_cast("double"))  # the pattern lets no NaN through


def numeric_or_number(c, dtype: str | None) -> Column:
    """Numeric columns pass through (NaN → null); text goes through ``to_number``."""
    if dtype is not None and dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") \
            or (dtype or "").startswith("decimal"):
        v = _c(c).cast("double")
        return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    return to_number(c)


# ── Fixed value (must equal the reference's): two-digit years from here on are of the century before ──
PIVOT_YEAR = 2069


def parse_timestamp(c, fmt: str | None) -> Column:
    """Text → timestamp with one format; unparseable → null."""
    col = _c(c)
    if fmt is None:
        return col.cast("string").try_cast("timestamp")
    ts = F.try_to_timestamp(col.cast("string"), F.lit(fmt))
    if "yy" in fmt and "yyy" not in fmt:  # Spark reads two digits as 2000 to 2099
        ts = F.when(F.year(ts) >= PIVOT_YEAR, ts - F.expr("INTERVAL '100' YEAR")).otherwise(ts)
    return ts


def choose_date_format(df: DataFrame, col: str, formats: list[str] | None = None) -> tuple[str | None, int, int]:
    """(format, rejected values, values): the format that rejects the fewest values of the whole column.

    ``None`` stands for the reader's own ISO forms and comes first; of formats that
    reject equally many, the first of the list wins (so a column that reads both as
    month/day and as day/month is month/day). If every format rejects every value the
    answer is ``None``. One aggregate per distinct text, then one over those.
    """
    formats = formats or DATE_FORMATS
    txt = F.trim(F.col(col).cast("string"))
    seen = df.select(txt.alias("v")).where("v IS NOT NULL AND v <> ''").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    tried = [F.col("v").try_cast("timestamp"), *[F.try_to_timestamp("v", F.lit(f)) for f in formats]]
    row = seen.agg(F.sum("n"), *[F.sum(F.when(t.isNull(), F.col("n")).otherwise(0)) for t in tried]).first()
    total = row[0] or 0
    if not total:
        return None, 0, 0
    best = min(range(len(tried)), key=lambda i: (row[1 + i], i))
    return ([None, *formats][best] if row[1 + best] < total else None), row[1 + best], total


def detect_date_format(df: DataFrame, col: str, formats: list[str] | None = None) -> str | None:
    """The format of ``choose_date_format``."""
    return choose_date_format(df, col, formats)[0]


def elapsed_days(later, earlier) -> Column:
    """Whole days elapsed between two timestamps (floor of elapsed wall-clock time, D4).

    Calendar-day difference, minus one when the later time of day is earlier;
    this equals floor(elapsed / 1 day) and does not depend on the session time
    zone's daylight-saving shifts.
    """
    a, b = _c(later), _c(earlier)
    tod = "HH:mm:ss.SSSSSS"
    days = F.datediff(F.to_date(a), F.to_date(b))
    return (days - F.when(F.date_format(a, tod) < F.date_format(b, tod), 1).otherwise(0)).cast("bigint")


def month_str(c) -> Column:
    """'yyyy-MM' period text of a timestamp."""
    return F.date_format(_c(c), "yyyy-MM")


def day_str(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")
