import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwise.functions import numeric as N
from tillwise.functions import text as T
from tillwise.functions.quantile import exact_quantiles, exact_quantiles_multi


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_title_case_matches_python(spark):
    for s in ["NEW YORK-city o'neil", "3rd street", "  são paulo ", "hello_world x2y"]:
        assert _one(spark, T.title_case("v"), s) == s.title()


def test_currency_percent_thousands_rating_category(spark):
    assert _one(spark, F.trim(T.strip_currency("v")), "₹1,099") == "1099"
    assert _one(spark, F.trim(T.strip_currency("v")), " $ 12,345.50 ") == "12345.50"
    assert _one(spark, T.strip_percent("v"), " 64% ") == "64"
    assert _one(spark, T.strip_thousands("v"), "24,269") == "24269"
    assert _one(spark, T.extract_rating("v"), "4.2 out of 5 stars") == "4.2"
    assert _one(spark, T.extract_rating("v"), "no stars") is None
    assert _one(spark, T.top_category("v"), "Electronics|Cables|USB") == "Electronics"


def test_to_number_rejects_junk(spark):
    assert _one(spark, N.to_number("v"), "1.5") == 1.5
    assert _one(spark, N.to_number("v"), " 2e3 ") == 2000.0
    for junk in ["1.5d", "nan", "", "abc", None]:
        assert _one(spark, N.to_number("v"), junk) is None


def test_elapsed_days_floors_time_of_day(spark):
    df = spark.createDataFrame([("2024-01-03 00:00:00", "2024-01-01 12:00:00")], "a string, b string")
    row = df.select(N.elapsed_days(F.to_timestamp("a"), F.to_timestamp("b")).alias("d"),
                    F.datediff(F.to_timestamp("a"), F.to_timestamp("b")).alias("dd")).first()
    assert row["d"] == 1 and row["dd"] == 2


def test_date_format_is_the_one_that_rejects_least(spark):
    def choose(*values):
        return N.choose_date_format(spark.createDataFrame([(v,) for v in values], "date string"), "date")

    assert choose("14-03-25", "02-04-25") == ("dd-MM-yy", 0, 2)
    assert choose("2023-01-05") == (None, 0, 1)  # the reader's own ISO form
    # the first value alone reads as month/day too
    assert choose("03/04/2025", "25/04/2025", "30/04/2025") == ("dd/MM/yyyy", 0, 3)
    assert choose("03/04/2025", "05/06/2025") == ("MM/dd/yyyy", 0, 2)
    assert choose("25.12.2024", "soon", "", None, "26.12.2024") == ("dd.MM.yyyy", 1, 3)
    assert choose("soon", None) == (None, 1, 1)
    assert choose(None, " ") == (None, 0, 0)
    assert choose() == (None, 0, 0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60),
       st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]))
def test_exact_quantiles_match_numpy(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, "x", [p], buckets=4)[0]
    want = float(np.quantile(np.array(values), p))
    assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9)


def test_exact_quantiles_ignore_nulls_and_share_passes(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 6.0), (3.0, float("nan")), (2.0, 7.0)], "a double, b double")
    q = exact_quantiles_multi(df, ["a", "b"], [0.5])
    assert q["a"] == [2.0] and q["b"] == [6.0]
    empty = spark.createDataFrame([], "a double")
    assert exact_quantiles(empty, "a", [0.5]) == [None]


def test_exact_quantiles_heavy_ties_and_wide_range(spark):
    values = [5.0] * 3000 + [1.0, 2.0, 1e9, -1e9] + [float(i) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.01, 0.25, 0.5, 0.9, 0.999]
    got = exact_quantiles(df, "x", probs)
    want = [float(np.quantile(np.array(values), p)) for p in probs]
    assert all(math.isclose(g, w, rel_tol=1e-12, abs_tol=1e-9) for g, w in zip(got, want))


def test_quantiles_of_extreme_doubles_and_of_too_few_passes(spark):
    values = [-1.7e308, -1.0, 0.0, 2.0, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0], buckets=3) == values
    with pytest.raises(RuntimeError, match="not settled after 0 passes"):
        exact_quantiles(df, "x", [0.5], max_passes=0)


def test_two_digit_years_and_rejected_dates(spark):
    from tillwise.operators import clean as C
    raw = spark.createDataFrame([(v,) for v in ("05-04-68", "05-04-69", "31-12-99", "01-01-00", "99-99-99", "", None, "17-03-25")], "date string")
    typed = C.coerce_types(raw)
    got = [str(r["date"])[:10] for r in typed.collect()]
    assert got == ["2068-04-05", "1969-04-05", "1999-12-31", "2000-01-01", "None", "None", "None", "2025-03-17"]
    assert tuple(C.date_rejects(raw, typed).first()) == (6, 1)
    four = spark.createDataFrame([("05-04-2099",)], "date string")
    assert str(C.coerce_types(four).first()["date"])[:10] == "2099-04-05"
