"""Fee reports: one HTML table per file, with the declarant named above it.

All of it is row-wise: one input row per file becomes its receipts through
``explode``. Nothing is shuffled, and files are read in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anualia.functions.markup import (
    cell_text,
    element_text,
    elements,
    filled_rows,
    row_cells,
    running_text,
    table_rows,
    tables,
    visible,
)
from anualia.functions.rut import normalize_rut
from anualia.functions.template import quote, with_computed
from anualia.functions.text import strip
from anualia.plans.fees import RECEIPT_COLUMNS
from anualia.sources.listing import list_files, with_files

NBSP = "\u00a0"
HEADER_ROW = 2  # rows 0 and 1 hold free text
CHECKED_COLUMNS = ["Fecha", "Estado", "Brutos", "Retenido", "Pagado"]

# Patterns of the declarant's name and RUT, and the text for "none".
NAME_PATTERN = r"(?iuU)Contribuyente:\s*([A-ZÁÉÍÓÚÑ0-9 .,&\-]+?)\s+RUT"
RUT_PATTERN = r"(?iuU)RUT\s*[:\-]?\s*([0-9]{1,2}\.?[0-9]{3}\.?[0-9]{3}\s*-\s*[0-9Kk])"
UNKNOWN = "No disponible"


def read_pages(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file: path, name, number in order, and the whole markup.

    Bytes that are not valid UTF-8 are taken as ISO-8859-1.
    """
    files = list_files(spark, paths)
    raw = (
        spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True)
        .select("value", "_metadata.file_path", F.col("_metadata.file_name").alias("file"))
    )
    html = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    )
    return with_files(raw, files.select("file_path", "file_no")).select(
        "file", "file_no", html.alias("html")
    )


def html_cells(pages: DataFrame, ids: list[str], row_tag: str, cell_tag: str) -> DataFrame:
    """Every cell of every row element: ids, row_no, col_no, text."""
    rows = pages.select(
        *ids, F.posexplode(elements(visible(F.col("html")), row_tag)).alias("row_no", "_row")
    )
    cells = rows.select(
        *ids, "row_no", F.posexplode(elements(F.col("_row"), cell_tag)).alias("col_no", "_cell")
    )
    return cells.select(*ids, "row_no", "col_no", cell_text(F.col("_cell")).alias("text"))


def contributor_name(text: Column) -> Column:
    """Name of the declarant in a report's running text."""
    found = F.regexp_extract(text, NAME_PATTERN, 1)
    return F.when(found != "", strip(found)).otherwise(UNKNOWN)


def contributor_rut(text: Column) -> Column:
    """RUT of the declarant in a report's running text."""
    found = F.regexp_extract(text, RUT_PATTERN, 1)
    return F.when(found != "", normalize_rut(found)).otherwise(UNKNOWN)


def parse_reports(pages: DataFrame, columns: Sequence[str] = RECEIPT_COLUMNS) -> DataFrame:
    """One row per file: its data rows, column positions, declarant, and why it is unusable.

    ``pages`` has ``file``, ``file_no`` and ``html``.
    """
    first_table = F.get(tables(visible(F.col("html"))), F.lit(0))
    tabled = with_computed(pages.select("file", "file_no", "html"), "_table", first_table)
    split = with_computed(tabled.drop("html"), "_split", table_rows(F.col("_table")))
    rowed = with_computed(split, "_rows", filled_rows(F.col("_split"))).drop("_split")
    cells = with_computed(rowed, "_cells", row_cells(F.get("_rows", F.lit(HEADER_ROW))))
    header = F.transform("_cells", lambda c: strip(F.translate(element_text(c), NBSP, " ")))
    headed = with_computed(cells, "_header", header).drop("_cells")

    def count_of(name: str) -> Column:
        return F.expr(f"size(filter(_header, h -> h = {quote(name)}))")

    reason = (
        F.when(F.col("_table").isNull(), "no table found")
        .when(F.size("_rows") <= HEADER_ROW, "no header row")
    )
    for name in CHECKED_COLUMNS:
        reason = reason.when(count_of(name) != 1, f"not exactly one column {name}")
    judged = with_computed(headed, "reason", reason)
    text = F.col("_text")
    return with_computed(judged, "_text", running_text(F.col("_table"))).select(
        "file", "file_no",
        F.slice("_rows", HEADER_ROW + 2, F.greatest(F.size("_rows"), F.lit(1))).alias("rows"),
        F.struct(*[
            (F.array_position("_header", name) - 1).cast("int").alias(f"p{i}") for i, name in enumerate(columns)
        ]).alias("positions"),
        contributor_name(text).alias("Nombre_Empresa_Declarante"),
        contributor_rut(text).alias("Rut_Empresa_Declarante"),
        "reason",
    )


def rejects(parsed: DataFrame) -> DataFrame:
    """Files that cannot be used, and why; the others go on."""
    return parsed.filter(F.col("reason").isNotNull()).select("file", "reason")


def fee_receipts(parsed: DataFrame, columns: Sequence[str] = RECEIPT_COLUMNS) -> DataFrame:
    """One row per table row of the usable files, all columns as text, in source order.

    A row without a cell at a column's position has null there.
    """
    rows = parsed.filter(F.col("reason").isNull()).select(
        F.posexplode("rows").alias("_row_no", "_row"), "file", "file_no", "positions",
        "Nombre_Empresa_Declarante", "Rut_Empresa_Declarante",
    )
    cells = with_computed(rows, "_cells", row_cells(F.col("_row")))
    picked = [
        F.when(F.col(f"positions.p{i}") >= 0, cell_text(F.get("_cells", F.col(f"positions.p{i}")))).alias(name)
        for i, name in enumerate(columns)
    ]
    order = F.col("file_no").cast("bigint") * F.lit(1 << 31) + F.col("_row_no")
    return cells.select(
        *picked, F.col("file").alias("Archivo_Origen"), "Nombre_Empresa_Declarante",
        "Rut_Empresa_Declarante", order.alias("ord"),
    )


def last_declarant(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Last known name and RUT over files in order, each on its own."""
    def last_known(name: str) -> Column:
        known = F.when(F.col(name) != UNKNOWN, F.col("file_no"))
        return F.coalesce(F.max_by(F.col(name), known), F.lit(UNKNOWN)).alias(name)

    return files.groupBy(*(by or [])).agg(
        last_known("Nombre_Empresa_Declarante"), last_known("Rut_Empresa_Declarante")
    )
