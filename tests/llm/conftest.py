import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id string, run string, "
          "score string, kept string, _text string, id string, keep_id string, bucket string")


def make(spark, rows):
    """Documents from (doc_id, text), with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x"] * 8) for i, t in rows], SCHEMA)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(random.Random(k).choices("aeinorstlu", k=2 + k % 7)) for k in range(vocabulary)]
    return " ".join(rng.choices(names, k=words))


BASE = prose(1, 120)
EDGE = [
    (1, BASE), (2, BASE), (3, BASE), (3, BASE),  # copies and a repeated row
    (4, None), (5, ""), (6, " \t\n"), (None, "no id but text"), (None, None), (7, "word"), (8, "Word"),
    (9, BASE + " and one more"), (10, prose(2, 60_000)), (11, "x" * 200_000), (12, "été ÉTÉ straße 日本語 ▁ \x00 \U0001f600"),
    (13, prose(3, 200)), (14, prose(3, 200)[:-20] + " changed the very end"), (15, "a\nb\r\nc\td\x0be\x0cf"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return make(spark, EDGE).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])
