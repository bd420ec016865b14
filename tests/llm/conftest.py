"""Rows of documents for the operators' tests."""

import random

import pytest

from marlstone.llm.common import ready

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, b long"


@pytest.fixture(scope="session")
def llm_spark(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def make_docs(llm_spark):
    """Documents from (doc_id, text[, lang]) with extra columns whose names clash with those inside operators."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or ""), "clash", 1, 2) for r in rows]
        return llm_spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose of so many words."""

    def make(seed, n, vocabulary=400):
        rnd = random.Random(seed)
        words = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(vocabulary)]
        return " ".join(rnd.choice(words) for _ in range(n))

    return make
