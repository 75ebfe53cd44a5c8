import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

ODD = [
    (1, "Plain words of a text that is here.\nAnd another line.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n\x0b\x0c\r ", "fr", "b"),
    (5, "Plain words of a text that is here.\nAnd another line.", "en", "a"),
    (6, "é ü ß 中文 😀 \x00\x01 end", "de", "b"),
    (7, "word " * 5000, "en", "a"),
    (8, "x" * 70000, "en", "c"),
    (None, "no id at all", "en", None),
    (9, "same row", "en", "b"),
    (9, "same row", "en", "b"),
    (10, "A b C d e f g h", "en", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty, very long, repeated rows, and extra columns with names that clash."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({"SCORE": F.lit("mine"), "verdict": F.lit(1), "licences": F.lit("x"), "predicted": F.lit(None).cast("string")}).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
