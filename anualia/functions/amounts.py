"""Peso arithmetic, exact in whole numbers.

Rates and factors have three decimals, so ``amount * factor`` is held in
thousandths of a peso as BIGINT: no float and no slow wide decimal on the hot
path. ANSI mode makes an overflow (amounts near 10^16 pesos) an error, not a
wrong figure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anualia.functions.template import apply, quote
from anualia.functions.text import STRIP

# A cast that fails costs far more than a pattern that does not match, so every
# cast is guarded by the pattern of what it accepts.
INTEGER = r"^\s*[+-]?[0-9]{1,18}\s*$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _parse(round_with: str) -> str:
    """Rule that reads number text ``p`` as a whole number, null if it is none."""
    return f"""p -> CASE
        WHEN p RLIKE {quote(INTEGER)} THEN cast(p AS BIGINT)
        WHEN p RLIKE {quote(NUMBER)} THEN try_cast({round_with}(cast(p AS DOUBLE)) AS BIGINT) END"""


_UNGROUPED = r"""CASE
    WHEN {x} RLIKE r'^\s*-?[0-9,]+(\.[0-9]*)?\s*$' THEN replace({x}, ',', '')
    ELSE {x} END"""
_NOTATION = r"""CASE
    WHEN t RLIKE r'^-?[0-9]+\.0+$' THEN t
    WHEN contains(t, '.') AND contains(t, ',') THEN translate(replace(t, '.', ''), ',', '.')
    WHEN t RLIKE r'\.[^.]{3}$' THEN replace(t, '.', '')
    WHEN t RLIKE r',[^,]{3}$' THEN replace(t, ',', '')
    WHEN contains(t, ',') THEN translate(t, ',', '.')
    ELSE t END"""

# Plain integers take the short way; only other texts go through the rules.
COERCE_INTEGER = f"""CASE WHEN {{x}} RLIKE {quote(INTEGER)} THEN cast({{x}} AS BIGINT) ELSE coalesce(
    transform(array({STRIP.replace("{x}", _UNGROUPED)}), {_parse("")})[0],
    0L) END"""

CLEAN_PLAIN = f"""CASE WHEN {{x}} IS NULL THEN 0L ELSE coalesce(
    transform(array({STRIP.replace("{x}", "translate({x}, '.,', '')")}), {_parse("")})[0],
    0L) END"""

CLEAN_LOCALE = f"""CASE WHEN {{x}} RLIKE {quote(INTEGER)} THEN cast({{x}} AS BIGINT) ELSE coalesce(
    transform(
        transform(array(translate({STRIP}, '$ ', '')), t -> {_NOTATION}),
        {_parse("rint")})[0],
    0L) END"""


def half_up_sql(value: str, unit: int = 1000) -> str:
    """SQL text of ``value / unit`` rounded to an integer, ties away from zero."""
    half = unit // 2
    return f"(({value}) + IF(({value}) < 0, -{half}L, {half}L)) DIV {unit}L"


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division, truncated toward zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint") if isinstance(b, int) else b)


def half_up(value: Column, unit: int) -> Column:
    """Round ``value / unit`` to an integer, ties away from zero."""
    half = F.lit(unit // 2).cast("bigint")
    return int_div(value + F.when(value < 0, -half).otherwise(half), unit)


def round_peso(value: Column) -> Column:
    """Round a decimal amount to whole pesos, ties away from zero; null stays null."""
    return F.round(value, 0).cast("bigint")


def round_peso_or_zero(value: Column) -> Column:
    """As ``round_peso`` but a missing amount counts as 0."""
    return F.coalesce(round_peso(value), F.lit(0).cast("bigint"))


def restate(amount: Column, factor_milli: Column) -> Column:
    """Amount times factor, rounded to pesos."""
    return half_up(amount * factor_milli, 1000)


def rate_rounded(amount: Column, rate_milli: int) -> Column:
    """Rounded share of an amount, e.g. 14.5% of gross."""
    return half_up(amount * F.lit(rate_milli).cast("bigint"), 1000)


def rate_truncated(amount: Column, rate_milli: int) -> Column:
    """Share of an amount cut toward zero, e.g. 3% of gross."""
    return int_div(amount * F.lit(rate_milli).cast("bigint"), 1000)


def split_withholding(
    gross: Column, withheld: Column, fee_rate_milli: int = 145, loan_rate_milli: int = 30
) -> dict[str, Column]:
    """Base withholding, excess, loan share and fee share of one receipt."""
    base = rate_rounded(gross, fee_rate_milli)
    excess = withheld - base
    loan = F.when(excess > 0, rate_truncated(gross, loan_rate_milli)).otherwise(F.lit(0))
    return {"base": base, "excess": excess, "loan": loan, "fee": withheld - loan}


def coerce_integer(x: str | Column) -> Column:
    """Fee-report amount: comma groups dropped, dot is decimal, truncated, bad is 0."""
    return apply(COERCE_INTEGER, x)


def clean_amount_plain(x: str | Column) -> Column:
    """Rental-sheet amount: every dot and comma is a separator and goes; bad is 0."""
    return apply(CLEAN_PLAIN, x)


def clean_amount_locale(x: str | Column) -> Column:
    """Payroll amount in Chilean or plain notation, rounded half to even; bad is 0.

    A single separator followed by exactly three characters groups thousands,
    except that a text such as ``500.000`` counts as a plain decimal.
    """
    return apply(CLEAN_LOCALE, x)


def whole_number(x: str | Column) -> Column:
    """Amount that is a number already: cut to an integer, missing is 0."""
    return apply("coalesce(try_cast({x} AS BIGINT), 0L)", x)


def rounded_number(x: str | Column) -> Column:
    """Amount that is a number already: rounded half to even, missing is 0."""
    return apply("coalesce(try_cast(rint({x}) AS BIGINT), 0L)", x)


def format_amount(c: Column) -> Column:
    """Amount with dots between thousands; missing shows as 0."""
    return F.coalesce(F.translate(F.format_number(c, 0), ",", "."), F.lit("0"))
