"""The progressive wage tax, forward and inverse, in exact whole numbers.

Units: bounds in tenths of UTM, factor ``k`` in thousandths, rebate in
hundredths of UTM. With ``N = 100*tax + rebate*utm`` the income behind a tax is
``10*N/k`` pesos, so both the bracket test and the rounding need no division
that could lose a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anualia.params import Bracket, YearParameters


def utm_sql(month_no: str, params: YearParameters) -> str:
    """SQL text of a month's UTM; null for a null month."""
    values = ", ".join(f"{v}L" for v in params.utm)
    return f"get(array({values}), {month_no} - 1)"


def _between(value: str, unit: str, b: Bracket, scale: int = 1) -> str:
    """SQL test of ``over < value <= upto`` with bounds in ``unit``."""
    test = f"{value} > {unit} * {b.over_tenths * scale}L"
    if b.upto_tenths is not None:
        test += f" AND {value} <= {unit} * {b.upto_tenths * scale}L"
    return test


def tax_forward(base: str, utm: str, params: YearParameters) -> Column:
    """Tax on a month's income: bracket (over, up to], rounded half up, never below 0.

    ``base`` and ``utm`` are SQL text, best plain column names.
    """
    arms = []
    for b in params.brackets:
        milli = f"{base} * {b.factor_milli}L - {utm} * {b.rebate_cents * 10}L"
        tax = "0L" if b.factor_milli == 0 else f"greatest(({milli} + 500L) DIV 1000L, 0L)"
        arms.append(f"WHEN {_between(f'{base} * 10L', utm, b)} THEN {tax}")
    return F.expr(f"CASE {' '.join(arms)} ELSE 0L END")


def tax_inverse(tax: str, utm: str, params: YearParameters) -> Column:
    """Income a tax was computed from, rounded half up; null if there was no tax.

    ``tax`` and ``utm`` are SQL text, best plain column names.
    """
    arms = [f"WHEN {tax} <= 0 THEN NULL"]
    for b in params.brackets:
        k = b.factor_milli
        if k:
            n = f"({tax} * 100L + {utm} * {b.rebate_cents}L)"
            arms.append(f"WHEN {_between(f'{n} * 100L', utm, b, k)} THEN ({n} * 20L + {k}L) DIV {2 * k}L")
    return F.expr(f"CASE {' '.join(arms)} END")


def join_bracket(df: DataFrame, amount: str, month: str, params: YearParameters) -> DataFrame:
    """Left range join of an amount to its bracket of the month.

    The bracket table has 12 months times the number of brackets, so broadcasting
    it is safe at any scale. Each row meets only its own month's brackets because
    the month is an equality key.
    """
    spark = df.sparkSession
    brackets = F.broadcast(params.bracket_table(spark).withColumnRenamed("month", "_month"))
    ten = F.col(amount) * 10
    return df.join(
        brackets,
        (F.col(month) == F.col("_month"))
        & (ten > F.col("over_tenths"))
        & (F.col("upto_tenths").isNull() | (ten <= F.col("upto_tenths"))),
        "left",
    ).drop("_month")
