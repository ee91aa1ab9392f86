import random

import pytest

WORDS = "the of and to in is that it for on with as was at by an be this which or from had not but what all were when we there can".split()


@pytest.fixture(scope="session")
def prose():
    """A function that makes reproducible prose of n words."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """A function that makes documents from (doc_id, text) rows; clash adds columns with names that operators use themselves."""

    def make(rows, clash=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "1 AS key", "'x' AS ids", "2 AS ref", "3 AS score", "4 AS blob", "5 AS tokens") if clash else df

    return make


@pytest.fixture(scope="session")
def edge(prose):
    """Rows with every awkward case: null and empty texts, null and repeated ids, repeated rows, ties, a very long text and word."""
    long = prose(30_000, 1)
    return [(1, prose(80, 2)), (2, None), (3, ""), (4, " \n\t"), (5, "one"), (6, "!!! ??? ..."), (7, long), (8, "x" * 200_000), (None, prose(60, 3)), (None, prose(60, 3)), (1, prose(80, 2)), (9, prose(80, 2)), (10, "é ß 中文 😀 naïve " * 20), (11, "a\x00b \x1f " + prose(20, 4))]
