import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice("abcdeghilmnoprst") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null and empty texts, a very long one, ties, repeated rows and near copies."""
    r = random.Random(3)
    base = words(r, 200)
    own = [(None, None, None, None, None), (None, "no id\nline", "en", "s1", 10), (1, None, "en", None, None), (2, "", "de", "s1", 0), (3, " \t\n", None, "s2", 3), (4, "a", "en", "s2", 1)]
    own += [(5, "Line One\nline one \nLINE ONE\n\nother", "en", "s0", 30), (6, words(r, 30_000), "fr", "s0", None), (7, "é ü ß 漢字 Ωmega\x00end", "de", "z", 5)]
    for i in range(20):
        own.append((20 + i, words(r, r.randint(5, 120)) + "\nshared line\n" + ("twice\ntwice\n" if i % 2 else ""), r.choice(["en", "de"]), f"s{i % 4}", 1))
    for i in range(6):
        w = base.split()
        w[i * 7] = "changed"
        own.append((50 + i, " ".join(w), "en", "s3", 1))
    own += [(60, base, "en", "s3", 1), (61, base, "en", "s3", 1), own[20], own[20], (20, "another text with an id that repeats", "en", "s1", 3)]
    return own


@pytest.fixture(scope="session")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with extra columns whose names the operators use inside."""
    return odd.withColumns({c: F.lit(1) for c in ("size", "fp", "key", "piece", "score", "anchor", "taken", "id", "shard", "rank", "toxic")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
