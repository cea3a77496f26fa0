import random

import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, key STRING, score DOUBLE, tokens INT, label INT, text_a STRING, epoch INT"


def prose(seed: int, words: int, stem: str = "w") -> str:
    r = random.Random(seed)
    return " ".join(f"{stem}{r.randrange(100000)}" for _ in range(words))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with further columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "src1")), len(r[1] or ""), "k", 0.5, 7, 1, "x", 3) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long, repeated rows and ties."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "é 😀 x"), (5, prose(5, 60)), (5, prose(5, 60)), (6, prose(5, 60)),
        (7, prose(7, 30000)), (8, "a" * 50000), (9, "same line\n" * 500), (None, prose(9, 40)), (10, prose(10, 50), None, None), (11, "x ", "de", "odd source"),
    ]
