"""Chilean tax ids (RUT)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from anualia.functions.text import strip

# Fixed value: shape of a normalised RUT. The check digit is not verified.
_SHAPE = r"^[0-9]{7,8}-[0-9K]$"
_DIGITS = r"^[0-9]{1,18}$"


def normalize_rut(c: Column) -> Column:
    """Upper case without dots and blanks; null becomes the empty string."""
    return F.translate(F.upper(strip(F.coalesce(c.cast("string"), F.lit("")))), ". ", "")


def rut_is_valid(c: Column) -> Column:
    """Does the normalised RUT have the right shape?"""
    return normalize_rut(c).rlike(_SHAPE)


def rut_order(c: Column) -> Column:
    """Number before the dash, 0 if there is none (rent and payroll lists)."""
    number = F.split_part(normalize_rut(c), F.lit("-"), F.lit(1))
    return F.when(number.rlike(_DIGITS), number.cast("bigint")).otherwise(F.lit(0))


def rut_order_raw(c: Column) -> Column:
    """All but the last character as number, null if malformed (fee lists)."""
    digits = strip(F.translate(c, ".-", ""))
    number = F.left(digits, F.length(digits) - 1)
    return F.when(number.rlike(_DIGITS), number.cast("bigint"))


def is_valid_text(rut: str) -> bool:
    """Driver-side shape check for the declarant's own RUT."""
    return bool(re.match(_SHAPE, rut.strip().upper().replace(".", "").replace(" ", "")))
