import pytest
from pyspark.sql import functions as F

LONG = "Alpha beta gamma delta epsilon zeta eta theta. " * 4000
PLAIN = " ".join(f"word{i}" for i in range(80)) + "."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and very long texts, ties, repeated rows, and columns named like helper columns."""
    rows = [(1, PLAIN, "en", "s0", 10), (1, PLAIN, "en", "s0", 10), (2, PLAIN, None, "s0", None), (3, None, "en", None, 0),
            (4, "", "en", "s1", 0), (5, " \t\n\x0b ", None, None, None), (6, LONG, "de", "s1", 5), (7, LONG + "End", "de", "s1", 5),
            (None, PLAIN + " Tail", "fr", "s2", 5), (None, None, None, None, None), (8, "no", "fr", "s2", 2),
            (9, "<|endoftext|> <|im_end|>\n \x1c it's 5 ÀÉ ſtraße ΑΣ", "fr", "s2", 2), (10, "123 456", "fr", "s2", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("doc", "_salt", "own", "id", "a", "b", "n", "bucket", "start", "t1", "shard", "weight", "probability", "tokens",
                 "topic", "row_id", "class_id", "_cell", "words", "item_id", "_block", "kept", "end", "x.y"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
