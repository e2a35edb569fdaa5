"""Small fixtures for the operators."""

import pytest

WORD = "[^\\x20\\x09-\\x0D]+"


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


CLASHES = ["keys", "pivot", "member", "n", "score", "kept", "spans", "sequence_id", "offset", "drop", "host", "row", "t", "x", "a", "base", "y", "slot", "language", "accepted", "n_lines", "_keep", "_id", "component_id"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    long = " ".join(f"w{i % 5000} Lorem, ipsum" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "One TWO three"), (6, long), (7, long), (8, "same row here"), (8, "same row here"), (None, "no id at all"), (9, "x@y.co +1 (766) 555-2373 1.2.3.4 4111 1111 1111 1111"), (10, "éÉ😀 ü\x1cz <|endoftext|> nul\x00l"), (11, "\n".join(["a repeated line of words", "another"] * 3)), (12, "a repeated line of words")]
    df = spark.createDataFrame([(i, t, "en" if t else None, "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    return df.cache()
