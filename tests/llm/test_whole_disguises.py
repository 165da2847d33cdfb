"""Disguises that stand alone, mixed, or far from others of their kind."""

import time

import pytest

from anualia.llm import pii
from anualia.llm.pii import find


def found(text):
    return [(pii.KINDS[s.kind], text[s.start : s.end]) for s, _ in pii.find(text)]


@pytest.mark.parametrize("disguised, kind", [
    ("+49 170 five 12 34 56 78", "phone"), ("+49 170 12 34 56 five", "phone"), ("+four 9170 12 34 56", "phone"),
    ("+fünf (12) 34-56 78", "phone"), ("+49.170.12.34.FIVE", "phone"),
    ("four 111 1111 1111 1111", "card"), ("4111 1111 one 111 1111", "card"), ("4111 1111 1111 111 one", "card"),
])
def test_one_spelled_digit_among_digits(disguised, kind):
    for text in (disguised, f"Call {disguised}.", f"Call {disguised}; or: one two"):
        assert (kind, disguised) in found(text)


@pytest.mark.parametrize("disguised, kind", [
    ("jane at example.com", "email"), ("jane arroba example.es", "email"), ("jane AROBASE mail.example.fr", "email"),
    ("jane at example [dot] com", "email"), ("jane at example&#46;com", "email"), ("jane (at) example dot com", "email"),
    ("jane&#64;mail punkt example.de", "email"), ("jane at mail.example dot com", "email"), ("jane at mail dot example (dot) com", "email"),
    ("10[.]0 dot 0.1", "ip"),
])
def test_signs_alone_mixed_and_with_a_named_dot_far_off(disguised, kind):
    for text in (disguised, f"Write: {disguised}, thanks", f"Write: {disguised}, thanks. That is the point of it."):
        assert found(text) == [(kind, disguised)]


def test_times_and_numbers_after_at_are_no_addresses():
    for text in ("see me at 10.30 today", "it stood at 3.5 percent", "look at e.g. this", "meet at 5 p.m. sharp"):
        assert found(text) == found(f"{text}, and the point is made") == []


CLEAN = [
    "Look at google.com for more.", "You can find us at example.com today.", "I shop at amazon.de a lot.", "It was sold at 10.com in May.",
    "More news at bbc.co.uk tonight", "Sign up at example.org now.", "We met at 10.30 in front of the house.", "Prices start at 9.99 per month.",
    "Available at shop.example.com, free.", "Read it online at nytimes.com", "See the list @ home . Then go.", "meet me @ example.com",
    "The point at issue. Com is a word.", "He pointed at it. It fell.", "Version 1 dot 2 is out.", "one two buckle my shoe three four",
    "Stay at home. No one came.", "The shop @ 5 . It was shut.", "They laughed at everything.com did.", "the dot at the end of the line",
]
FOUND = {
    "jane at example.com": (0, 19), "write to bob.smith at example.com please": (9, 33), "jane @ example . com": (0, 20),
    "mail j.doe\n(at)\nexample.com": (5, 27), "x\t[at]\tex\t[dot]\tcom": (0, 19), "anna arroba correo.es": (0, 21), "jane at example dot com": (0, 23),
    "me99 @ mail . example . org now": (0, 27), "Kontakt: udo at firma.de": (9, 24),
}


@pytest.mark.parametrize("text", CLEAN)
def test_clean_sentences_have_no_span(text):
    assert find(text) == []


@pytest.mark.parametrize("text", FOUND)
def test_disguised_addresses(text):
    assert [(s.start, s.end, base) for s, base in find(text)] == [(*FOUND[text], False)]


def test_no_span_is_added_to_plain_prose(spark):
    """Of the given documents, only those with personal data, plain or disguised, have added spans."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    added = [text[s.start : s.end] for (text,) in rows for s, base in find(text) if not base]
    assert all(any(c.isdigit() or c in "@([{" for c in t) or " dot " in t.lower() or " at " in t.lower() for t in added)


@pytest.mark.parametrize("piece", ["jаne (at) ехample (dot) com ", "one two three four five six, ", "a at b.com ", "x @ y . zz ", "é ＋49 plus "])
def test_long_texts_take_time_in_proportion(piece):
    def seconds(n):
        text = piece * (n // len(piece))
        began = time.process_time()
        find(text)
        return time.process_time() - began

    seconds(1_000)
    short, long = seconds(60_000), seconds(960_000)
    assert long < 16 * 3 * max(short, 0.05)
