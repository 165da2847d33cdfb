"""Checks: issue tables, month coverage and the gates that stop a job.

Checks are ordinary DataFrames that can be shown, written or counted. A gate is
the one action that turns a non-empty check into an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from anualia.functions.months import codes_sql, mask_codes, month_bit, month_code, month_number

ERROR, WARNING = "E", "W"

Rule = tuple[str, str, str, str]  # severity, name, condition and message, the last two as SQL text


class ValidationError(ValueError):
    """Raised by a gate; ``issues`` holds the full table, not only the sample shown."""

    def __init__(self, message: str, issues: DataFrame | None = None):
        super().__init__(message)
        self.issues = issues


def issue_table(
    df: DataFrame, ids: list[str], rules: list[Rule]
) -> DataFrame:
    """Long table of broken rules: ids, severity, rule, message.

    Rows without any issue leave through a plain filter first, so only faulty
    rows pay for building the list.
    """
    broken = " OR ".join(f"({condition})" for _, _, condition, _ in rules)
    found = ", ".join(
        f"CASE WHEN {condition} THEN named_struct("
        f"'severity', '{severity}', 'rule', '{rule}', 'message', {message}) END"
        for severity, rule, condition, message in rules
    )
    return df.filter(broken).select(*ids, F.expr(f"inline(array_compact(array({found})))"))


def rule_counts(issues: DataFrame, severity: str = ERROR) -> DataFrame:
    """How often each rule of this severity is broken: rule, n."""
    return issues.where(F.col("severity") == severity).groupBy("rule").agg(F.count("*").alias("n"))


def gate(issues: DataFrame, severity: str = ERROR, sample: int = 20) -> None:
    """Raise if the table has an issue of this severity.

    The error shows counts per rule and a few messages; the whole table stays
    available on the error and is never pulled to the driver.
    """
    bad = issues.filter(F.col("severity") == severity)
    counts = rule_counts(issues, severity).orderBy("rule").collect()
    if counts:
        lines = [f"{r['rule']}: {r['n']}" for r in counts]
        lines += [r["message"] for r in bad.select("message").limit(sample).collect()]
        raise ValidationError("the data has errors\n" + "\n".join(lines), bad)


@dataclass(frozen=True)
class Watch:
    """What a frame counted while it was written; asking waits for that first action."""

    observation: Observation
    rules: list[Rule]

    def rows(self) -> int:
        return self.observation.get["rows"]

    def broken(self, severity: str = ERROR) -> dict[str, int]:
        """Broken rules of this severity and how often they are."""
        counts = self.observation.get
        return {rule: counts[rule] for level, rule, _, _ in self.rules if level == severity and counts[rule]}


def watch_rules(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, Watch]:
    """The frame, which counts its rows and broken rules during its first action, without a job of its own."""
    watch = Watch(Observation(), rules)
    counts = [F.expr(f"count_if({condition})").alias(rule) for _, rule, condition, _ in rules]
    return df.observe(watch.observation, F.count(F.lit(1)).alias("rows"), *counts), watch


def require_rows(df: DataFrame, message: str) -> None:
    """Raise if the frame is empty."""
    if df.isEmpty():
        raise ValidationError(message)


def month_coverage(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Coverage of the months by the files of each declarant.

    ``files`` has one row per file and a ``month`` code, null when the name tells
    none. The result has the months present, the first of them, those missing
    from there to December, those given twice, and the number of files without a
    month. State per declarant is three integers, whatever the number of files.
    """
    by = by or []
    number = month_number(F.col("month"))
    per_month = files.groupBy(*by, number.alias("_no")).agg(F.count("*").alias("_files"))
    bit = month_bit(F.col("_no"))
    masks = per_month.groupBy(*by).agg(
        F.coalesce(F.bit_or(bit), F.lit(0)).alias("_seen"),
        F.coalesce(F.bit_or(F.when(F.col("_files") > 1, bit)), F.lit(0)).alias("_twice"),
        F.min("_no").alias("_first"),
        F.coalesce(F.sum(F.when(F.col("_no").isNull(), F.col("_files"))), F.lit(0)).alias("undetected"),
    )
    return masks.select(
        *by,
        month_code(F.col("_first")).alias("first_month"),
        mask_codes("_seen").alias("present"),
        F.expr(codes_sql("{i} >= _first AND getbit(_seen, {i} - 1) = 0")).alias("missing"),
        mask_codes("_twice").alias("duplicated"),
        F.col("undetected").cast("bigint").alias("undetected"),
    )


def month_issues(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Coverage problems as an issue table, in the order they are checked."""
    return issue_table(month_coverage(files, by), by or [], [
        (ERROR, "undetected_month", "undetected > 0",
         "concat('files whose name tells no month: ', undetected)"),
        (ERROR, "duplicate_month", "duplicated <> ''",
         "concat('months given more than once: ', duplicated)"),
        (ERROR, "no_month", "first_month IS NULL", "'no file names a month'"),
        (ERROR, "missing_month", "missing <> ''",
         "concat('first month is ', first_month, '; missing up to December: ', missing)"),
    ])
