"""Bring a frame to a fixed set of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anualia.functions.template import name as quote_name
from anualia.functions.template import with_computed


def quoted(name: str) -> Column:
    """Column whose name may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(column_type(df, name), T.NumericType)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Raise, before any job runs, if compulsory columns are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
    return df


def drop_blank_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop rows in which every one of the named columns present is null.

    The test is a computed column: as a plain filter over two dozen columns it
    would make constraint propagation try every combination of later aliases.
    """
    present = [quote_name(n) for n in names if n in df.columns]
    if not present:
        return df
    blank = F.expr(" AND ".join(f"{n} IS NULL" for n in present))
    return with_computed(df, "_blank", blank).filter("NOT _blank").drop("_blank")


def conform_columns(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Select the names in order, absent ones as empty text; extra columns go."""
    kept = [quoted(k) for k in keep if k in df.columns]
    return df.select(
        *kept, *[quoted(n) if n in df.columns else F.lit("").alias(n) for n in names]
    )


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is null there."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def number_text(df: DataFrame, name: str) -> Column:
    """Column as text; a number that is whole shows no decimals."""
    c = quoted(name)
    if isinstance(column_type(df, name), (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = c.try_cast("bigint")
        return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))
    return c.cast("string")
