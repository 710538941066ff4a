import random

import pytest

from reelframe.session import ship

SCHEMA = "doc_id long, text string, lang string, sha string, kept boolean, pos int, w string, chunk long, fp string, h string, n int, q int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows, parts=3):
        full = [(i, t, "en", "x", True, 1, "a b", 7, "0", "h", 3, 4) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic text of n made-up words."""

    def make(seed, n, kinds=400):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(1 + rng.randrange(kinds) % 3)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd():
    """Rows that every operator must stand: nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "Ünïcödé ÀÉ ② 漢字 🙂 x"), (6, long), (7, long), (7, "other text"), (8, "a\x00b\x1fc")]
