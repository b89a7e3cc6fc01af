from tillwise.operators import schema as A

EXPORT_HEADER = ["Order ID", "Date", "Product", "Category", "Price", "Quantity", "Total Sales",
                 "Customer Name", "Customer Location", "Payment Method", "Status"]


def test_exact_map_first_column_wins():
    m = A.canonical_map(["Price", "Total Sales", "Customer-Name", "user id"])
    assert m == {"Price": "price", "Customer-Name": "customer_id"}


def test_fuzzy_harmonise_export_header(spark):
    cols = spark.createDataFrame([(0, i, c) for i, c in enumerate(EXPORT_HEADER)],
                                 "source_id int, position int, column_name string")
    rows = {r["column_name"]: (r["canonical"], r["score"]) for r in A.harmonise_schemas(cols).collect()}
    assert rows["Order ID"][0] == "transaction_id"
    assert rows["Total Sales"][0] is None          # price already taken by the earlier column
    assert rows["Customer Location"][0] == "region"
    assert rows["Payment Method"] == (None, 50.0)
    assert rows["Status"] == (None, 72.7)


def test_similarity_values(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("status", "state"), ("abc", "abc"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(A.similarity(F.col("a"), F.col("b"))).collect()]
    assert round(got[0], 1) == 72.7 and got[1] == 100.0 and got[2] == 100.0


def test_detect_dataset_type():
    assert A.detect_dataset_type(["customer_id", "date", "quantity", "price"]) == "transactional"
    assert A.detect_dataset_type(["customer_id", "rating"]) == "review"
    assert A.detect_dataset_type(["customer_id", "price", "product_id"]) == "catalog"
    assert A.detect_dataset_type(["customer_id"]) == "transactional"


def test_canonicalise_requires_customer(spark):
    import pytest
    df = spark.createDataFrame([(1,)], "amount int")
    with pytest.raises(ValueError):
        A.canonicalise(df)


def test_admission_message(spark):
    raw = spark.range(150)
    clean = spark.range(4)
    row = A.admission(raw, clean).first()
    assert not row["admitted"] and "only 4 valid rows" in row["message"] and row["rows_removed"] == 146
