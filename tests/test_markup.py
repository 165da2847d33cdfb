"""Tables inside tables and cells over several rows."""

import random
import re

from pyspark.sql import functions as F

from anualia.functions import markup
from anualia.sources.html_reports import fee_receipts, parse_reports


def column(spark, pages, fn):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r[0] for r in df.select("i", fn(F.col("html")).alias("v")).orderBy("i").select("v").collect()]


def test_outermost_tables(spark):
    pages = [
        "x<table><tr><td>a<table><tr><td>1</td><td>2</td></tr></table>b</td></tr></table>y<TABLE id=2><tr><td>c</td></tr></table >",
        "</table><table></table><table><tr><td><table><tr><td>deep<table><td>er</table></table></table>",
        "<table><tr><td>never closed", "<tables><td>no table</tables>", "", None,
    ]
    assert column(spark, pages, markup.tables) == [
        ["<tr><td>a12b</td></tr>", "<tr><td>c</td></tr>"], ["<tr><td>deeper"], ["<tr><td>never closed"], [], [], None,
    ]


def grid(rows):
    """Where the cells of rows stand, each given as (text, rows, columns): a cell fills its columns and waits for later rows."""
    out, waiting = [], []
    while rows or waiting:
        own, rows = (rows[0], rows[1:]) if rows else ([], [])
        line, later = [], []

        def place(text, left, col):
            line.append(text)
            if left:
                later.append((text, left, col))

        for text, down, across in own:
            while waiting and waiting[0][2] <= len(line):
                t, left, col = waiting.pop(0)
                place(t, left - 1, col)
            for _ in range(across):
                place(text, down - 1, len(line))
        for t, left, col in waiting:
            place(t, left - 1, col)
        out.append(line)
        waiting = later
    return out


def test_cells_over_rows(spark):
    rng = random.Random(0)
    cases = []
    for _ in range(300):
        rows = [[(f"t{rng.randrange(99)} rowspan", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2])) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 6))]
        rows[0].append(("s", 2, 1))
        cases.append(rows)
    pages = [
        "<table>" + "".join("<tr>" + "".join(f"<td rowspan={d} colspan='{a}'>{t}</td>" for t, d, a in r) + "</tr>" for r in rows) + "</table>"
        for rows in cases
    ]
    got = column(spark, pages, lambda html: markup.filled_rows(markup.table_rows(F.get(markup.tables(html), F.lit(0)))))
    assert [[re.findall(r"<td>([^<]*)", row) for row in page] for page in got] == [grid(rows) for rows in cases]


def test_report_with_spans_and_nested_tables(spark):
    page = """<table><tr><td rowspan=2><table><tr><td>Contribuyente: ACME</td><td> RUT 76.123.456-K</td></tr></table></td><td>x</td></tr><tr></tr>
    <tr><td>Fecha</td><td>Estado</td><td>Rut</td><td>Nombre o Razón Social</td><td>Brutos</td><td>Retenido</td><td>Pagado</td></tr>
    <tr><td rowspan=3>1/1/2025</td><td>VIGENTE</td><td rowspan=2>1-9</td><td>A</td><td>10</td><td>1</td><td>9</td></tr>
    <tr><td>ANULADA</td><td>B</td><td>20</td><td>2</td><td>18</td></tr></table>"""
    pages = spark.createDataFrame([("f", 0, page)], "file string, file_no int, html string")
    rows = fee_receipts(parse_reports(pages)).orderBy("ord").collect()
    assert [tuple(r)[:7] for r in rows] == [
        ("1/1/2025", "VIGENTE", "1-9", "A", "10", "1", "9"), ("1/1/2025", "ANULADA", "1-9", "B", "20", "2", "18"),
        ("1/1/2025", None, None, None, None, None, None),
    ]
    assert (rows[0]["Nombre_Empresa_Declarante"], rows[0]["Rut_Empresa_Declarante"]) == ("ACME", "76123456-K")
