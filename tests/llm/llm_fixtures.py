"""Documents for the tests of this folder."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use themselves, with other types and values.
CLASHING = ("n_words", "size", "place", "pattern", "node", "name", "gram", "length", "salt", "seed", "kept", "row", "open", "component_id", "held_out")


def invented(n: int, seed: int = 0, words: int = 60, vocabulary: int = 400) -> list[str]:
    """Prose of made-up words."""
    draw = random.Random(seed)
    names = ["".join(draw.choice(("ra", "lo", "mi", "te", "su", "ven", "dor", "ki")) for _ in range(draw.randint(1, 4))) for _ in range(vocabulary)]
    return [" ".join(draw.choice(names) for _ in range(draw.randint(words // 2, words))) for _ in range(n)]


@pytest.fixture
def documents(spark):
    """Documents from texts: ids from 0, two languages, three sources."""

    def make(texts, clash: bool = False):
        rows = [(i, t, "ab"[i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if clash:
            for name in CLASHING:
                df = df.withColumn(name, F.array(F.lit("x")))
        return df

    return make


@pytest.fixture
def odd_documents(spark):
    """Null, empty, blank and very long texts, ties, repeated rows, a null id and clashing columns."""
    long_text = " ".join(invented(400, seed=9)) + " " + "x" * 50_000
    plain = invented(4, seed=3)
    rows = [
        (1, None, "a", "s0", None), (2, "", "a", None, 0), (3, " \t\n ", None, "s1", 4), (4, long_text, "a", "s1", 1),
        (5, plain[0], "b", "s2", 1), (5, plain[0], "b", "s2", 1), (6, plain[0], "b", "s2", 1), (None, plain[0], "a", None, None),
        (7, plain[1], None, None, 5), (-8, "one two", "a", "s0", 7), (9, "Ünï 👍 \u0085 wörd", "b", "s0", 9), (10, "\x00\x01 ퟿", None, None, 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in CLASHING:
        df = df.withColumn(name, F.array(F.lit("x")))
    return df
