"""Monthly parameters of several years as a table, joined by the row's own year and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anualia.operators.quality import ValidationError
from anualia.params import YearParameters, registered_years

# Rows of a parameter table that may be broadcast: a thousand years of months.
BROADCAST_ROWS = 12_000
KEY = ["commercial_year", "month_no"]


def parameter_table(spark: SparkSession, years: list[YearParameters] | None = None) -> DataFrame:
    """One row for each month of the years (all registered ones by default): year, month number, factor in thousandths, UTM."""
    rows = [
        (y.commercial_year, i + 1, factor, utm)
        for y in (registered_years() if years is None else years)
        for i, (factor, utm) in enumerate(zip(y.factor_milli, y.utm))
    ]
    return spark.createDataFrame(rows, "commercial_year int, month_no int, factor_milli long, utm long")


def checked_parameters(table: DataFrame) -> DataFrame:
    """A table read from anywhere, as parameters: typed columns, one row for each year and month.

    ``table`` has commercial_year, month_no, factor (decimal or text) and utm.
    """
    typed = table.select(
        F.col("commercial_year").cast("int"), F.col("month_no").cast("int"),
        (F.col("factor").cast("decimal(9,3)") * 1000).cast("long").alias("factor_milli"), F.col("utm").cast("long"),
    )
    bad = typed.groupBy(*KEY).count().where("count > 1 OR commercial_year IS NULL OR month_no IS NULL OR month_no NOT BETWEEN 1 AND 12")
    if found := bad.limit(5).collect():
        raise ValidationError("parameters given twice or without a month: " + ", ".join(f"{r[0]}-{r[1]}" for r in found), bad)
    return typed


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _own(df: DataFrame, date: Column) -> DataFrame:
    return df.select("*", F.year(date).alias("commercial_year"), F.month(date).alias("month_no"))


def with_parameters(df: DataFrame, table: DataFrame, date: Column) -> DataFrame:
    """Add year, month, factor_milli and utm of each row's date; null where the table has none."""
    return _own(df, date).join(_small(table), KEY, "left")


def unknown_months(df: DataFrame, table: DataFrame, date: Column) -> DataFrame:
    """Years and months of rows that the table does not know or has no factor for, with their rows."""
    known = table.where("factor_milli IS NOT NULL").select(*KEY)
    seen = _own(df, date).groupBy(*KEY).agg(F.count("*").alias("rows"))
    return seen.join(_small(known), KEY, "left_anti")
