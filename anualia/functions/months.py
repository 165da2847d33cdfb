"""Months: detection, codes, lookups and compact month sets.

The set of months of a payee is kept as a 12-bit mask while aggregating. A mask
is a fixed-width buffer, so the aggregate stays a hash aggregate inside
whole-stage codegen, where ``collect_set`` would force an object aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from anualia.functions.template import apply
from anualia.params import MONTHS

# Month names looked for in a file name, in this order.
MONTH_NAMES = {
    "enero": "ENE",
    "febrero": "FEB",
    "marzo": "MAR",
    "abril": "ABR",
    "mayo": "MAY",
    "junio": "JUN",
    "julio": "JUL",
    "agosto": "AGO",
    "septiembre": "SEP",
    "setiembre": "SEP",
    "octubre": "OCT",
    "noviembre": "NOV",
    "diciembre": "DIC",
}

_MONTH_FROM_NAME = "CASE " + " ".join(
    f"WHEN contains({{x}}, '{word}') THEN '{code}'" for word, code in MONTH_NAMES.items()
) + " END"


def month_from_name(c: Column) -> Column:
    """Code of the first month, in calendar order, whose name occurs in the text."""
    return apply(_MONTH_FROM_NAME, F.lower(c))


def receipt_date(c: Column) -> Column:
    """Date written day/month/year; anything else is null."""
    return F.try_to_timestamp(c, F.lit("d/M/yyyy")).cast("date")


def tax_year(date: Column) -> Column:
    """Year in which the commercial year of a date is declared."""
    return F.year(date) + 1


def pick(values: Sequence, month_no: Column) -> Column:
    """Value of a month out of twelve constants; null for a null month.

    ``get`` and not ``element_at``: on an array without nulls the latter declares
    itself not nullable and so loses a null position.
    """
    literals = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return F.get(F.expr(f"array({literals})"), month_no - 1)


def month_code(month_no: Column) -> Column:
    """1..12 to the month code."""
    return pick(MONTHS, month_no)


def month_number(code: Column) -> Column:
    """Month code to 1..12, null if unknown."""
    return F.nullif(F.array_position(F.expr(f"array{MONTHS}"), code), F.lit(0)).cast("int")


def by_month(values: Sequence[int | None], month_no: Column) -> Column:
    """Look up a 12-value parameter by month number; null month gives null."""
    return pick(values, month_no).cast("bigint")


def month_bit(month_no: Column) -> Column:
    """Mask with the bit of one month set."""
    return pick([1 << i for i in range(12)], month_no)


def in_mask(mask: str, month_no: int) -> str:
    """SQL test: is this month in the mask?"""
    return f"({mask} & {1 << (month_no - 1)}) <> 0"


def flag_sql(condition: str) -> str:
    """SQL text: ``X`` or the empty text."""
    return f"CASE WHEN {condition} THEN 'X' ELSE '' END"


def mask_flags(mask: str) -> list[Column]:
    """``X`` or empty text for each of the twelve months, named by month code."""
    return [F.expr(f"{flag_sql(in_mask(mask, i + 1))} AS {code}") for i, code in enumerate(MONTHS)]


def mask_months(mask: str) -> Column:
    """Sorted array of the month numbers in the mask."""
    slots = ", ".join(f"IF({in_mask(mask, i)}, {i}, 0)" for i in range(1, 13))
    return F.expr(f"array_remove(array({slots}), 0)")


def codes_sql(condition: str) -> str:
    """Month codes for which the condition over ``{i}`` holds, as ``ENE, FEB``."""
    parts = ", ".join(f"CASE WHEN {condition.replace('{i}', str(i + 1))} THEN '{code}' END" for i, code in enumerate(MONTHS))
    return f"concat_ws(', ', {parts})"


def mask_codes(mask: str) -> Column:
    """Month codes in the mask, in calendar order."""
    return F.expr(codes_sql(f"getbit({mask}, {{i}} - 1) = 1"))
