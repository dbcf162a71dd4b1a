import pytest

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

# Names that the operators use inside, as columns of the input.
CLASHING = ("size", "unit", "k", "t", "bits", "key", "count", "score", "taken", "source_size", "copies", "code", "label_", "found")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in any column, empty, blank and very long texts, ties, repeated rows and other columns."""
    from pyspark.sql import functions as F

    long_text = "The quick brown fox and the lazy dog. " * 20_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b\f\r ", "en", "a", 6), (4, long_text, "en", None, None),
        (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (6, "one two", None, "b", 7), (None, "no id here", "en", "c", 10),
        (None, None, None, None, None), (7, "123 !!! ---", "de", "", 11), (8, "日本語 テキスト \U0001f600", "ja", "c", None),
        (9, "x" * 300_000, "en", "c", 300_000), (10, "<|endoftext|> a", "en", "c", 15), (-3, "minus  three words", "fr", "d", 19),
    ]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    for name in CLASHING:
        frame = frame.withColumn(name, F.lit("other"))
    return frame


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
