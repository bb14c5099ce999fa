import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "n r st ll m ck th x".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


ODD = [None, "", " \t\n", "one", "two words", "étaç über naïve", "x" * 5000, "same line here now and then again today", prose(1, 40), prose(1, 40)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, deleted string, key string"


def rows_of(texts, first=0):
    """Rows with columns whose names clash with those the operators use inside."""
    return [(first + i, t, None, None if i % 5 == 4 else f"s{i % 3}", None, 1, "x", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Small, with all that is awkward: nulls, empty and long texts, ties, repeated rows."""
    base = prose(2, 60)
    near = base.replace(base.split()[7], "changed", 1)
    texts = [*ODD, base, near, base, prose(3, 300) + "\n" + base, prose(4, 900), *[prose(100 + i, 30) for i in range(20)]]
    data = rows_of(texts)
    return spark.createDataFrame([*data, data[9], (None, base, "en", "s0", 1, 1, "x", "k")], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, 1) for i in range(10, 30)] + [(None, 1, 1, 1), (5, None, None, 1)], "doc_id long, quality int, toxic int, text int")
