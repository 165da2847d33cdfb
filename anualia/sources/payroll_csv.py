"""Payroll books: one ``;``-separated file (or folder of part files) per month.

All books of a declaration are looked at in one distributed pass, which gives for
every file its header line, whether it is valid UTF-8, whether a quoted cell goes
over a line, and the largest number of cells of a line. Files of one header and
encoding are then read in one scan. Files with line breaks in cells are read by
record (``quoted_records``), the others by line.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anualia.functions.months import month_from_name
from anualia.functions.template import name as sql_name
from anualia.functions.template import with_computed
from anualia.functions.text import missing_to_null
from anualia.operators.conform import require_columns, union_by_name
from anualia.operators.quality import ValidationError, gate, month_issues
from anualia.plans.payroll import REQUIRED_COLUMNS
from anualia.scratch import materialize
from anualia.sources.listing import base_name, list_files, plain_path, split_order, split_row, with_files
from anualia.sources.quoted_records import bare_line, cell_count, left_open, quoted_records, record_text, text_lines

# How a book is recognised.
SEPARATOR = ";"
MORE_COLUMNS_THAN = 20
ENCODINGS = ("UTF-8", "ISO-8859-1")

_CSV = {"sep": SEPARATOR, "escape": '"'}


def book_months(files: DataFrame) -> DataFrame:
    """One row per book with the month its name tells, null if it tells none."""
    books = files.select("input_no", "file_name").distinct()
    return books.withColumn("month", month_from_name(F.col("file_name")))


def header_names(line: str) -> list[str]:
    """Column names of a header line; a repeated name gets ``.1``, ``.2`` and so on."""
    names, seen = [], {}
    for name in next(csv.reader([line.lstrip("﻿")], delimiter=SEPARATOR)):
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}.{count}" if count else name)
    return names


def profile_files(spark: SparkSession, files: DataFrame, paths: Sequence[str], encoding: str | None = None) -> DataFrame:
    """One row per file that has lines: its place in the list, header, encoding, whether a cell is left open, most cells.

    The pass over the lines is a hash aggregate that combines on the map side: lines
    with the name of the first compulsory column, such as the header, are keys of
    their own, and everything else is a number or a flag. A file whose first line
    is no such line has a null header.
    """
    lines = text_lines(spark, paths).where(F.trim("value") != "")
    bare = with_computed(lines, "bare", F.expr(bare_line("value", SEPARATOR)))
    headed = F.when(F.col("value").contains(REQUIRED_COLUMNS[0]), F.col("value").cast("binary"))
    per_key = bare.groupBy("file_path", headed.alias("header")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("ok"),
        F.expr(f"bool_or({left_open('bare', SEPARATOR)})").alias("open"),
        F.expr(f"max({cell_count('bare', SEPARATOR)})").alias("cells"),
        F.min(F.when(F.col("file_block_start") == 0, F.col("row"))).alias("first"),
    )
    per_file = per_key.groupBy("file_path").agg(
        F.bool_and("ok").alias("ok"), F.bool_or("open").alias("open"), F.max("cells").alias("cells"), F.min_by("header", "first").alias("header"),
    )
    # A book counts as UTF-8 if all of its files are valid.
    valid = F.bool_and("ok").over(W.partitionBy("input_no"))
    chosen = F.lit(encoding) if encoding else F.when(valid, ENCODINGS[0]).otherwise(ENCODINGS[1])
    listed = with_files(per_file, files).select("*", chosen.alias("encoding"))
    return materialize(listed.withColumn("header", F.decode("header", "ISO-8859-1")).drop("ok"), "book-files")


@dataclass(frozen=True)
class Layout:
    """Files that are read in one scan."""

    encoding: str
    names: tuple[str, ...]
    open: bool
    cells: int
    paths: tuple[str, ...]
    example: str


def layouts(profile: DataFrame) -> list[Layout]:
    """Files grouped by encoding, header and way of reading; only names and headers reach the driver."""
    keys = ["encoding", "header", "open"]
    path = plain_path(F.col("file_path")).alias("path")
    rows = profile.groupBy(*keys).agg(
        F.max("cells").alias("cells"), F.sort_array(F.collect_list(F.struct("file_no", path))).alias("files"), F.min_by("file_name", "file_no").alias("example")
    ).orderBy("files").collect()
    found = []
    for r in rows:
        header = (r["header"] or "").encode("ISO-8859-1").decode(r["encoding"], "replace")
        found.append(Layout(r["encoding"], tuple(header_names(header.rstrip("\r"))), r["open"], r["cells"], tuple(f["path"] for f in r["files"]), r["example"]))
    return found


def _records(spark: SparkSession, layout: Layout) -> tuple[DataFrame, tuple[str, ...]]:
    """Records of files with line breaks in cells, without the header, and the header's names."""
    records, unended = quoted_records(spark, layout.paths, SEPARATOR)
    if lost := unended.select(plain_path(F.col("file_path"))).limit(5).collect():
        raise ValidationError("a quoted cell never ends in " + ", ".join(r[0] for r in lost))
    text = records.withColumn("record", record_text(layout.encoding)).where(F.trim("record") != "")
    header = text.where("is_first").limit(1).collect()
    names = tuple(header_names(header[0]["record"])) if header else layout.names
    return text.where("NOT is_first").drop("is_first"), names


def _tagged(df: DataFrame, files: DataFrame, names: Sequence[str]) -> DataFrame:
    return with_files(df, files.select("file_path", "file_no", "file_name", "month")).select(
        *[missing_to_null(sql_name(c)).alias(c) for c in names],
        F.col("month").alias("MES_DJ"),
        F.col("file_name").alias("ARCHIVO_ORIGEN"),
        split_order(F.col("_row")).alias("ord"),
    )


def _schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def _scan_lines(spark: SparkSession, files: DataFrame, layout: Layout) -> DataFrame:
    """Files without line breaks in cells, in one scan that reads the columns asked for."""
    repeated = any(name.rpartition(".")[0] in layout.names and name.rpartition(".")[2].isdigit() for name in layout.names)
    raw = (
        spark.read.schema(_schema(layout.names)).options(**_CSV)
        .option("header", True).option("encoding", layout.encoding).option("enforceSchema", repeated).csv(list(layout.paths))
    )
    return _tagged(raw.select("*", "_metadata.file_path", "_metadata.file_block_start", split_row().alias("_row")), files, layout.names)


def _scan_records(files: DataFrame, records: DataFrame, names: Sequence[str]) -> DataFrame:
    plain = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = with_computed(records.withColumnRenamed("row", "_row"), "_cells", F.from_csv("record", plain, _CSV))
    flat = cells.select("file_path", "file_block_start", "_row", *[F.col(f"_cells.c{i}").alias(c) for i, c in enumerate(names)])
    return _tagged(flat, files, names)


def _ragged(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """Records with more cells than the header."""
    bare = with_computed(records, "_bare", F.expr(bare_line("record", SEPARATOR)))
    return bare.withColumn("cells", F.expr(cell_count("_bare", SEPARATOR))).where(F.col("cells") > len(names)).select(
        "file_path", "cells", F.lit(len(names)).alias("expected"), "record"
    )


def _layouts_of(spark: SparkSession, paths: Sequence[str], encoding: str | None) -> tuple[DataFrame, list[Layout]]:
    files = list_files(spark, paths)
    return files, layouts(profile_files(spark, files, paths, encoding))


def book_rejects(spark: SparkSession, paths: Sequence[str], encoding: str | None = None) -> DataFrame:
    """Records with more cells than their header: file_name, cells, expected, record. One is enough to refuse a book."""
    files, found = _layouts_of(spark, paths, encoding)
    bad = []
    for layout in found:
        if layout.open:
            bad.append(_ragged(*_records(spark, layout)))
        elif layout.cells > len(layout.names):
            lines = text_lines(spark, layout.paths).withColumn("record", F.regexp_replace(F.decode(F.col("value").cast("binary"), layout.encoding), "\r$", ""))
            bad.append(_ragged(lines, layout.names))
    if not bad:
        return spark.createDataFrame([], "file_name string, cells int, expected int, record string")
    return with_files(union_by_name(bad), files).select("file_name", "cells", "expected", "record")


def payroll_book(spark: SparkSession, paths: Sequence[str], encoding: str | None = None) -> DataFrame:
    """Read and check the books of one declaration and stack them by column name.

    ``paths`` are the books in order, each a file or a folder of part files; the
    name of the path tells the month. Months must be detected, unique and complete
    from the first one to December. A book counts as UTF-8 if all of it is valid,
    else as ISO-8859-1, unless ``encoding`` says otherwise. A book with a record of
    more cells than its header is refused (:func:`book_rejects` lists them); cells
    that a record lacks at its end are null. The number of jobs does not depend on
    the number of books or files.
    """
    listing = list_files(spark, paths)
    books = book_months(listing)
    gate(month_issues(books))
    found = layouts(profile_files(spark, listing, paths, encoding))
    files = listing.join(books.select("input_no", "month"), "input_no")

    scans = []
    for layout in found:
        records, names = _records(spark, layout) if layout.open else (None, layout.names)
        if len(names) <= MORE_COLUMNS_THAN:
            raise ValidationError(f"not a payroll book: {layout.example}")
        if layout.cells > len(names) if records is None else not _ragged(records, names).isEmpty():
            raise ValidationError(f"rows with more cells than the header has columns, {layout.example} or a later book", book_rejects(spark, paths, encoding))
        scans.append(_scan_lines(spark, files, layout) if records is None else _scan_records(files, records, names))
    if not scans:
        raise ValidationError("not a payroll book: no lines in " + ", ".join(base_name(p) for p in paths[:5]))
    return require_columns(union_by_name(scans), REQUIRED_COLUMNS)
