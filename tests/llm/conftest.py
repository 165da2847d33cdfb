"""A small table with every odd case: nulls, blanks, repeats, long texts, clashing names."""

import random

import pytest
from pyspark.sql import types as T

CLASHING = ["size", "words", "node", "label", "hash", "tie", "key", "doc", "place", "repeats", "spans", "score", "length", "item"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéèmnorstuw") for _ in range(rng.randint(1, 9))) for _ in range(n))


def odd_rows() -> list[tuple]:
    long_text = prose(1, 30_000)
    base = prose(2, 120)
    words = base.split()
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join([*words[:60], "changed", *words[61:]]), "en", "b"),
        (4, None, "en", "b"),
        (5, "", None, None),
        (6, " \t\n ", "en", None),
        (7, "one two", "en", "c"),
        (8, long_text, "en", "a"),
        (9, "Tab\tgap\x0bline\nfeed\r\nÀÉ éa  x", "fr", "c"),
        (None, prose(3, 50), "en", "b"),
        (None, prose(4, 50), None, "b"),
        (11, prose(5, 40), "en", "b"),
        (11, prose(6, 40), "en", "b"),
        (12, prose(7, 40), "en", "d"),
        (12, prose(7, 40), "en", "d"),
        (13, "\n".join([prose(8, 12)] * 6), "en", "a"),
        (14, "word " * 400, "en", "é"),
        (15, "mail a.b@c.de, ip 1.2.3.4 and 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 010-9999", "en", "z"),
        (16, "write jo [at] ex [dot] com or plus four nine one two three four five six seven", "en", "z"),
    ]


def frame(spark, rows):
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.LongType(), *[T.StringType()] * len(CLASHING)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    full = [(*r, len(r[1]) if r[1] else None, *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def no_docs(spark):
    return frame(spark, [])
