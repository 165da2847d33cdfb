"""Text helpers that match how the source files are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anualia.functions.template import apply, quote

# Every character Unicode counts as white space.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Cell texts that a tabular reader takes as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

STRIP = f"btrim({{x}}, {quote(WHITESPACE)})"
CLEAN = f"btrim(coalesce(cast({{x}} AS STRING), ''), {quote(WHITESPACE)})"
MISSING = f"CASE WHEN {{x}} NOT IN ({', '.join(quote(t) for t in MISSING_TEXTS)}) THEN {{x}} END"


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(x: str | Column) -> Column:
    """Null becomes the empty string; everything else is trimmed text."""
    return apply(CLEAN, x)


def missing_to_null(x: str | Column) -> Column:
    """Texts that stand for "no value" become null."""
    return apply(MISSING, x)


def default_if_blank(x: str, default: str) -> str:
    """SQL text that replaces the empty string by a default code."""
    return f"coalesce(nullif({x}, ''), {quote(default)})"
