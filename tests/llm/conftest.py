import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, band string, a string, th string, component string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def make(texts, source=None):
        rows = [(i, t, "en", (source or {}).get(i, "src"), len(t or ""), "x", "y", "z", "c") for i, t in texts]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded prose of a given number of words."""

    def write(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(n))

    return write
