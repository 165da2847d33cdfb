"""Quality rules as a short-circuit cascade.

A rule is a condition that rejects a text. On a bounded sample each rule is run
alone: the time it takes above a bare scan is its cost, the share of texts it
rejects its selectivity. The rules are then chained in one CASE expression by
rejection per cost, so that a text leaves at its first failing rule and costly
rules see only what the cheap ones let through. The order changes what is
computed, never the verdict: a text is kept when no rule rejects it.

Everything is built-in expressions. Windows of eight words are compared by hash
first; only texts in which two hashes agree compare the windows themselves, so
counts are exact.

Defined results: a null text has no words, lines or symbols; texts under the
least number of words fail; a rule whose value is null does not reject; equal
rows get equal verdicts; an empty table gives no rows, and rules keep the order
they were given in. Extra columns pass through ``cascade`` untouched.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anualia.llm.common import split_words
from anualia.scratch import materialize

WINDOW = 8
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_000
RUNS = 2  # that count, after one that compiles


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the columns ``text`` and ``words``."""

    name: str
    rejects: Column


# ---- measures of one text ------------------------------------------------------


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column) -> Column:
    """Characters among the symbols."""
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\x0b\f\r"))) > 0)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    bound = F.transform(F.array(lines(text)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return F.element_at(bound, 1).cast("long")


def _windows(words: Column, make) -> Column:
    """One value for each run of eight words."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    return F.transform(starts, lambda i: make(F.slice(words, i, F.lit(WINDOW)), i))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column) -> Column:
    """Words in windows that occur twice, by comparing the windows' text in sorted order."""
    window = F.array_sort(_windows(words, lambda run, i: F.struct(F.array_join(run, " ").alias("run"), i.alias("at"))))

    def twice(found):
        return F.filter(
            found,
            lambda x, j: F.coalesce((j > 0) & (F.get(found, j - 1).getField("run") == x.getField("run")), F.lit(False))
            | F.coalesce(F.get(found, j + 1).getField("run") == x.getField("run"), F.lit(False)),
        )

    places = F.array_sort(F.transform(_let(window, twice), lambda x: x.getField("at")))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    return F.aggregate(
        places, start,
        lambda sofar, at: F.struct(
            (sofar.getField("words") + at + WINDOW - F.greatest(at, sofar.getField("end"))).alias("words"),
            (at + WINDOW).alias("end"),
        ),
        lambda sofar: sofar.getField("words"),
    )


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight words found twice or more in the text."""
    hashes = _windows(words, lambda run, i: F.xxhash64(run))
    repeats = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((F.size(words) > WINDOW) & repeats, _covered(words)).otherwise(F.lit(0)).cast("long")


# ---- rules ---------------------------------------------------------------------


def _more_than(share: float, words: Column, test) -> Column:
    """Whether more than this share of the words pass the test; false without words."""
    return F.size(F.filter(words, test)) > F.size(words) * share


def default_rules() -> list[Rule]:
    """Rules beside the base ones; limits leave room for every language with word gaps."""
    words, text = F.col("words"), F.col("text")
    n_words = F.size(words)
    chars = word_chars(words)
    return [
        Rule("mean_word_length", (chars < n_words * 2) | (chars > n_words * 14)),
        Rule("symbol_ratio", symbol_count(text) > 0.1 * n_words),
        Rule("duplicate_lines", duplicate_lines(text) > 0.5 * F.size(lines(text))),
        Rule("stutter", F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))) > n_words * 0.3),
        Rule("capitals", _more_than(0.6, words, lambda w: (F.upper(w) == w) & (F.lower(w) != w))),
        # A word of a script without case has letters all the same.
        Rule("few_letters", _more_than(0.4, words, lambda w: (F.lower(w) == F.upper(w)) & ~w.rlike(r"\p{L}"))),
        Rule("long_words", _more_than(0.1, words, lambda w: F.length(w) > 40)),
    ]


def base_rules() -> list[Rule]:
    """Too few words, or too many words in repeated windows."""
    words = F.col("words")
    return [
        Rule("few_words", F.size(words) < MIN_WORDS),
        Rule("repeated_words", repeated_words(words) * 100 > F.size(words) * 30),
    ]


def _with_words(rows: DataFrame) -> DataFrame:
    """Add ``words`` behind a one-element explode.

    A condition on a plain projection would be moved below it with the split in
    place of the column, and inside a lambda it would run for every word.
    """
    return rows.select("*", F.explode(F.array(split_words(F.col("text")))).alias("words"))


# ---- cascade -------------------------------------------------------------------


def _timed(sample: DataFrame, condition: Column) -> tuple[float, float]:
    """Seconds and share of rejected rows of one condition over the sample.

    The first run compiles the condition and is not counted; of the others the
    fastest counts, which what else runs on the machine disturbs least.
    """
    least, share = float("inf"), 0.0
    for run in range(RUNS + 1):
        began = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double"))).first()[0] or 0.0
        least = min(least, time.perf_counter() - began) if run else least
    return least, share


def order_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, as found on at most about ``sample_rows`` texts.

    Values are compared in octaves, so that noise does not turn the order of rules
    that are about as good; these, and rules that reject nothing, go by name.
    """
    total = docs.count()
    part = docs.select(F.col(text_col).alias("text"))
    if total > sample_rows:
        part = part.sample(sample_rows / total, seed=42)
    sample = materialize(_with_words(part), "rule-sample").coalesce(1)
    bare, _ = _timed(sample, F.size("words") < 0)
    value = {}
    for rule in rules:
        seconds, share = _timed(sample, rule.rejects)
        value[rule.name] = round(math.log2(share / max(seconds - bare, bare / 10))) if share else -math.inf
    return sorted(rules, key=lambda r: (-value[r.name], r.name))


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    chain = None
    for rule in rules:
        chain = F.when(rule.rejects, rule.name) if chain is None else chain.when(rule.rejects, rule.name)
    return F.lit(None).cast("string") if chain is None else chain


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects."""
    ordered = order_rules(docs, base_rules() + default_rules() if rules is None else rules, text_col, sample_rows)
    rows = _with_words(docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text")))
    return rows.where(verdict(ordered).isNull()).select("doc.*")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base measures and the cascade's verdict of every document.

    The base rules are decided by the measures, which are reported for all
    documents; the other rules follow in the sampled order, on texts that passed.
    """
    ordered = order_rules(docs, default_rules(), text_col, sample_rows)
    rows = _with_words(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    base = rows.select(
        "doc_id", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("words")).alias("word_chars"),
        F.coalesce(symbol_count(F.col("text")), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(duplicate_lines(F.col("text")), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    judged = base.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), False).when(verdict(ordered).isNotNull(), False).otherwise(True)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )
