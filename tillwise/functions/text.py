"""String expressions used by cleaning, geography and rules (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Characters removed from money text before it is read as a number.
CURRENCY_CHARS = "₹$€£, \t\n\x0b\f\r"
# Text that stands for "no value" once an id column is turned into text.
ID_PLACEHOLDERS = ["None", "nan", ""]
# Region values (after title-casing) that carry no place.
GEO_PLACEHOLDERS = ["Nan", "None", "Unknown", "N/A", "Na", "", "Unspecified", "Other", "Null"]
# Words whose presence marks a basket of category names.
CATEGORY_KEYWORDS = ["electronic", "computer", "home", "kitchen", "cloth", "book", "sport",
                     "toy", "office", "music", "health"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_text(c) -> Column:
    """Value as trimmed text (null stays null, see quirk Q1)."""
    return F.trim(_c(c).cast("string"))


def strip_currency(c) -> Column:
    """B1: drop currency signs, thousands commas and whitespace."""
    return F.translate(_c(c).cast("string"), CURRENCY_CHARS, "")


def strip_percent(c) -> Column:
    """B2: drop '%' and trim."""
    return F.trim(F.replace(_c(c).cast("string"), F.lit("%"), F.lit("")))


def strip_thousands(c) -> Column:
    """Drop ',' and trim."""
    return F.trim(F.replace(_c(c).cast("string"), F.lit(","), F.lit("")))


def extract_rating(c) -> Column:
    """First decimal number in the text, null when there is none."""
    return F.nullif(F.regexp_extract(_c(c).cast("string"), r"(\d+\.?\d*)", 1), F.lit(""))


def top_category(c) -> Column:
    """Text before the first '|', trimmed."""
    return F.trim(F.split_part(_c(c).cast("string"), F.lit("|"), F.lit(1)))


def title_case(c) -> Column:
    """Python-style title case: upper after every non-letter, lower elsewhere.

    ``initcap`` only capitalises after spaces, so the text is cut into runs of
    letters and non-letters and each run is capitalised on its own.
    """
    runs = F.regexp_extract_all(F.lower(_c(c).cast("string")), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def first_word_lower(c) -> Column:
    """First whitespace-separated token, lower case ('' when blank)."""
    return F.lower(F.regexp_extract(_c(c).cast("string"), r"^\s*(\S+)", 1))


def has_category_keyword(items) -> Column:
    """True when any item text contains one of the category keywords."""
    joined = F.lower(F.array_join(_c(items), " "))
    cond = F.lit(False)
    for kw in CATEGORY_KEYWORDS:
        cond = cond | joined.contains(kw)
    return cond
