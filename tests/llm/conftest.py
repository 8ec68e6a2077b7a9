import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join(r.choice(["th", "an", "er", "on", "re", "st", "ou", "ea"]) + r.choice(["in", "tion", "ble", "ly", "nd"]) + r.choice(["a", "o", "es", "ing", "or", "u"]) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, sources=None):
        return spark.createDataFrame([(k, t, "en", sources[k] if sources else f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and extra columns with names that operators use themselves."""
    r = random.Random(1)
    long = words(r, 60_000)
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "some words here and a few more of them", "en", None, 3), (3, " \n ", "en", "a", 3), (4, "one two three four five six seven", "en", "b", 1), (4, "one two three four five six seven", "en", "b", 1), (5, "one two three four five six seven", "en", "b", 1), (5, "other words under the same id as before", "en", "c", 1), (6, long, "en", "b", 1), (7, "!!! ???", "en", "", 7), (8, "É1 ünï çødé \U0001f600 4111 1111 1111 1111", "en", "b", 9), (9, "x", "en", "b", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = {c: "1" for c in ("size", "key", "label", "score", "slot", "shard", "row_key", "fp", "taken", "words", "part", "x", "class_id", "__m", "__size")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in extra.items()})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 0, 1), (2, 0, 1), (4, 1, 0), (6, 7, 7)], "doc_id long, quality int, toxic int")
