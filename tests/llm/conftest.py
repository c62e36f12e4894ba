import random

import pytest
from llm_rows import SCHEMA, row


@pytest.fixture(scope="session")
def words():
    rng = random.Random(0)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd(spark, words):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties."""
    rng = random.Random(1)
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [row(1, None), row(2, ""), row(3, " \n\t"), row(4, long, None), row(5, "One two"), row(6, "ONE TWO", "b"), row(6, "ONE TWO", "b"), row(7, "Ünï cödé — ☃ 𝄞 É", None), row(None, "no identifier here"), row(None, None, None), row(8, "x" * 50_000), row(9, "one two", "c"), row(10, "\x80 odd \x00 sign")]
    rows += [row(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80))), rng.choice("abc")) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
