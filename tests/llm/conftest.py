import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard string, size string, id string, key string, label int, items string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, rows repeated as a whole, columns that clash."""
    r = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    body = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = body(20_000)
    same, rows = body(60), []
    texts = [None, "", " \n\t ", "one", long, "x" * 200_000, same, same, same, body(30), "😀 é 𝒳 " * 5, "a\n" * 3000, body(80), body(80)]
    near = same.split()
    texts.append(" ".join(near[:59] + ["other"]))
    for k, t in enumerate(texts):
        rows.append((k, t, "en", f"s{k % 3}" if k % 5 else None, None, True, "x", "y", "z", "q", 7, None))
    rows.append(rows[9])
    rows.append(rows[9])
    rows.append((None, body(40), None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
