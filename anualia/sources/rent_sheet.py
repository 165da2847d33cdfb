"""Rental sheets: one row per property, read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anualia.functions.template import name
from anualia.functions.text import missing_to_null
from anualia.operators.sequence import number_rows
from anualia.sources.listing import list_files, split_order, split_row, with_files


def rent_sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV sheet with a header; ``row_no`` is the position of the row in the file."""
    raw = (
        spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    )
    files = list_files(spark, [path])
    placed = (
        with_files(
            raw.select("*", "_metadata.file_path", "_metadata.file_block_start", split_row().alias("_row")),
            files.select("file_path", "file_no"),
        ).select(*[missing_to_null(name(c)).alias(c) for c in raw.columns], split_order(F.col("_row")).alias("_ord"))
    )
    return number_rows(placed, [F.col("_ord")], "row_no").drop("_ord")


def rent_table(df: DataFrame, order: str) -> DataFrame:
    """Any table as a rental sheet: rows are numbered by its order column."""
    return number_rows(df, [F.col(order)], "row_no")
