import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, shared ids, and extra columns with names operators use."""
    rng = random.Random(3)
    vocabulary = [f"w{n}" for n in range(400)] + ["É", "straße", "don't", "日本", "x y", "🙂"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(300)
    rows = [
        (1, base), (2, base), (3, base.replace("w1 ", "W1 ")), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, text(60_000)),
        (9, base + " " + text(20)), (10, "\n".join([text(12)] * 9)), (None, text(80)), (None, base), (11, text(100)), (11, text(100)),
        (12, "a" * 5000), (12, "a" * 5000), (13, "b\n" * 600), (14, base[50:1200]), (15, text(70)),
    ]
    schema = "doc_id long, text string, size string, a int, block double, sid string, `group` string"
    return spark.createDataFrame([(d, t, "s", 1, 0.5, None, "g") for d, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def few_labels(spark):
    return spark.createDataFrame([(n, n % 2, (n + 1) % 2) for n in range(1, 16)] + [(None, 1, 0), (7, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
