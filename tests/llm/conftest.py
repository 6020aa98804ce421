import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def documents(spark, small):
    """Texts by id of the smallest table."""
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    return {r["doc_id"]: r for r in rows}


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "x", "b"), (5, long, "b"),
            (6, "Same text here for two rows\nand a second line that is the same", "b"),
            (6, "Same text here for two rows\nand a second line that is the same", "b"),
            (7, "Same text here for two rows\nand a second line that is the same", None),
            (None, "no id on this row of the table", "c"),
            (None, "no id on this row of the table", "c"),
            (8, "漢字 и кириллица é́ İ K ſ 🎉   \x85 end", "ü"), (-9, "negative id", "c")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for name in ("n_words", "key", "node", "row", "label", "size", "kept", "lang"):
        from pyspark.sql import functions as F
        frame = frame.withColumn(name, F.lit(None).cast("string"))
    return frame.withColumn("n_chars", F.length("text").cast("bigint"))
