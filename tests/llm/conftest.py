import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("the", "ri", "mo", "sta", "bel", "ko", "lu", "ver") for b in ("n", "ra", "st", "dor", "mi", "", "lek")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def doc(i, text, source="a"):
    return (i, text, "en", source, len(text or ""))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and a column whose name clashes."""
    rng = random.Random(1)
    long = sentence(rng, 60_000)
    base = sentence(rng, 80)
    near = base.replace(base.split()[40], "zzz", 1)
    rows = [
        (None, None, None, None, None),
        doc(1, None),
        doc(2, ""),
        doc(3, " \t\n"),
        doc(4, long, None),
        doc(5, base),
        doc(5, base),
        doc(6, near, "b"),
        doc(7, base.replace(" ", "\n")),
        doc(8, "é\U0001f600 don't  　x\x85y", "b"),
        doc(9, "one two", "c"),
        doc(10, long, "c"),
    ]
    frame = spark.createDataFrame(rows, DOC)
    from pyspark.sql import functions as F

    return frame.withColumn("size", F.lit("x")).withColumn("score", F.lit("y")).withColumn("key", F.lit(1)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
