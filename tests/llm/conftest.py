from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

#: Names that operators use inside.
CLASHING = ("node", "set_key", "text_key", "size", "component_id", "key", "row", "grp", "d2", "part", "spans", "bucket", "finish", "score", "id", "own", "word")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcdef'[rng.randrange(6)]}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls, empty, blank, tiny, long, repeated and near texts."""
    rng = random.Random(5)
    base = sentence(rng, 160)
    words = base.split()
    near = " ".join(words[:80] + ["changed"] + words[81:])
    far = " ".join(words[:60] + sentence(rng, 100).split())
    long = "\n".join(sentence(rng, 50) for _ in range(900))
    return [
        (5, base, "en", "a"),
        (9, base.upper(), "en", "a"),
        (2, near, None, "b"),
        (11, far, "en", None),
        (3, None, "en", "a"),
        (4, "", None, None),
        (6, " \n\t ", "fr", "b"),
        (7, "one two", "fr", "b"),
        (8, "One  TWO", "fr", "b"),
        (12, long, "en", "a"),
        (13, "x " + long, "en", "b"),
        (14, "é😀" * 60, "de", "c"),
        (14, "é😀" * 60, "de", "c"),
        (20, "é😀" * 60 + "z", "de", "c"),
        (None, base, "en", "a"),
        (None, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
