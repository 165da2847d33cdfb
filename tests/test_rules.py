"""Scalar rules, gates and the three returns on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from anualia import jobs
from anualia.functions import amounts, months, rut, tax
from anualia.operators.quality import ValidationError, gate, month_coverage, month_issues
from anualia.operators.sequence import number_rows
from anualia.params import MONTHS, TENANT, Declaration, for_year
from anualia.plans import fees, payroll, rent
from anualia.sinks.reports import read_sheet
from anualia.sources.payroll_csv import header_names

PARAMS = for_year()
WHO = Declaration("Ana", "12.345.678-5")


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_clean_amount_locale(spark):
    cases = {
        None: 0, "": 0, "-": 0, "None": 0, "$ 1.500": 1500, "500.000": 500, "1.234": 1234, "1.234.567": 1234567,
        "1.234,5": 1234, "1.235,5": 1236, "12.5": 12, "13.5": 14, "1,234": 1234, "1,5": 2, "2,5": 2, "abc": 0,
        "-1.234": -1234, "1.5e3": 15000, " 7 ": 7,
    }
    assert values(spark, list(cases), amounts.clean_amount_locale) == list(cases.values())


def test_clean_amount_plain(spark):
    cases = {None: 0, "": 0, "1.500.000": 1500000, "1,500": 1500, "500000.0": 5000000, "x": 0, " 12 ": 12, "-1.000": -1000}
    assert values(spark, list(cases), amounts.clean_amount_plain) == list(cases.values())


def test_coerce_integer(spark):
    cases = {None: 0, "150.000": 150, "1.234.567": 0, "1,234": 1234, "12.9": 12, "-12.9": -12, "abc": 0}
    assert values(spark, list(cases), amounts.coerce_integer) == list(cases.values())


def test_rounding_and_split(spark):
    row = spark.range(1).select(
        amounts.round_peso(F.lit("-2.5").cast("decimal(9,1)")).alias("a"),
        amounts.half_up(F.lit(-2500).cast("bigint"), 1000).alias("b"),
        *[c.alias(k) for k, c in amounts.split_withholding(
            F.lit(1_000_000).cast("bigint"), F.lit(175_000).cast("bigint")).items()],
    ).first()
    assert tuple(row) == (-3, -3, 145_000, 30_000, 30_000, 145_000)


def test_rut(spark):
    ids = ["1.234.567-8", " 12345678-k", "abc", None]
    assert values(spark, ids, rut.rut_is_valid) == [True, True, False, False]
    assert values(spark, ids, rut.rut_order) == [1234567, 12345678, 0, 0]
    assert values(spark, ids, rut.rut_order_raw) == [1234567, 12345678, None, None]


def test_months(spark):
    names = ["LRE_Setiembre.csv", "libro_mayor_junio.csv", "x.csv"]
    assert values(spark, names, months.month_from_name) == ["SEP", "MAY", None]
    dates = values(spark, ["1/3/2025", "31/2/2025", "2025-03-01"], months.receipt_date)
    assert [str(d) for d in dates] == ["2025-03-01", "None", "None"]
    got = spark.sql("SELECT cast(null AS INT) m").select(months.by_month([7] * 12, F.col("m"))).first()[0]
    assert got is None


def test_tax_inverse_hand_value_and_round_trip(spark):
    df = spark.range(1, 4000).selectExpr("id * 977 AS t", "cast(id % 12 + 1 AS INT) AS m")
    df = df.withColumn("utm", F.expr(tax.utm_sql("m", PARAMS)))
    df = df.withColumn("base", tax.tax_inverse("t", "utm", PARAMS))
    df = df.withColumn("again", tax.tax_forward("base", "utm", PARAMS))
    assert df.filter("base IS NULL OR again <> t").count() == 0
    one = spark.sql("SELECT 50000L t, 68034L utm").select(tax.tax_inverse("t", "utm", PARAMS)).first()[0]
    assert one == 2_104_740


def test_month_gates(spark):
    def files(*codes):
        return spark.createDataFrame([(c,) for c in codes], "month string")

    gate(month_issues(files(*MONTHS[2:])))
    row = month_coverage(files("OCT", "DIC", "DIC", None)).first()
    assert row.asDict() == {
        "first_month": "OCT", "present": "OCT, DIC", "missing": "NOV", "duplicated": "DIC", "undetected": 1,
    }
    for bad in (files("OCT", "DIC"), files("NOV", "DIC", "DIC"), files("NOV", "DIC", None)):
        with pytest.raises(ValidationError):
            gate(month_issues(bad))


def test_declaration():
    assert Declaration("Ana", "12.345.678-k").checked().tax_year == 2026
    with pytest.raises(ValueError):
        Declaration(" ", "1-9").checked()
    with pytest.raises(ValueError):
        for_year(1999)


@pytest.mark.parametrize("partitions", [1, 5])
def test_number_rows_with_one_hot_key(spark, partitions):
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, id, 7L) AS k", "id").repartition(partitions)
    rows = number_rows(df, [F.col("k"), F.col("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 3001))
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def receipts(spark, rows):
    data = [(*r, i) for i, r in enumerate(rows)]
    schema = "Fecha string, Estado string, Rut string, `Nombre o Razón Social` string, Brutos string, " \
        "Retenido string, Pagado string, ord bigint"
    return spark.createDataFrame(data, schema)


def test_fees_sum_then_round_and_first_name(spark):
    lines = fees.detail(receipts(spark, [
        ("5/1/2025", "VIGENTE", "1-9", "Uno", "100", "14", "86"),
        ("6/1/2025", "VIGENTE", "1-9", "UNO SA", "100", "14", "86"),
        ("6/1/2025", "ANULADA", "1-9", "Uno", "100", "14", "86"),
        ("7/3/2025", "VIGENTE", "2-7", "Dos", "1000000", "175000", "825000"),
        ("7/3/2025", "VIGENTE", "2-7", "Dos", "1000000", "0", "1000000"),
    ]))
    rows = fees.return_list(fees.annual(lines, PARAMS), numbered_headings=False).collect()
    assert [(r["Rut"], r[fees.NAME], r["Honorarios_Actualizado"], r["Prestamo_3_Actualizado"]) for r in rows] == [
        ("1-9", "Uno", 29, 0), ("2-7", "Dos", 148_190, 30_660),
    ]
    assert rows[0]["ENE"] == "X" and rows[0]["FEB"] == ""


def test_fees_without_date_stop(spark):
    lines = fees.detail(receipts(spark, [("x", "VIGENTE", "1-9", "Uno", "100", "14", "86")]))
    with pytest.raises(Exception, match="index factor"):
        fees.annual(lines, PARAMS).collect()


def test_fees_keys_raw_or_normalized(spark):
    lines = fees.detail(receipts(spark, [
        ("5/1/2025", "VIGENTE", "1.234.567-8", "A", "100", "14", "86"),
        ("6/1/2025", "VIGENTE", "1234567-8", "B", "100", "14", "86"),
    ]))
    assert fees.annual(lines, PARAMS).count() == 2
    assert fees.annual(lines, PARAMS, normalize_keys=True).count() == 1


REPORT = """<html><table><tr><td colspan="7">Contribuyente: ACME LTDA</td></tr>
<tr><td>RUT : 76.123.456-K</td></tr>
<tr><td>Fecha</td><td>Estado</td><td>Rut</td><td>Nombre&nbsp;o Raz&oacute;n Social</td><td>Brutos</td><td>Retenido</td><td>Pagado</td></tr>
{rows}<tr><td colspan=4>Totales* :</td><td>9</td><td>9</td><td>9</td></tr></table></html>"""


def report(*rows):
    cells = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>\n" for r in rows)
    return REPORT.replace("{rows}", cells)


def test_fee_job_from_files(spark, tmp_path):
    jan = report(("02/01/2025", "VIGENTE", "9.876.543-2", "Mu&ntilde;oz &amp; C&iacute;a", "1,000", "145", "855"))
    feb = report(("03/02/2025", "VIGENTE", "9.876.543-2", "Otro", "1000", "145", "855"),
                 ("03/02/2025", "ANULADA", "5-1", "Nulo", "1000", "145", "855"))
    (tmp_path / "a_enero.html").write_bytes(jan.encode("utf-8"))
    (tmp_path / "b_febrero.html").write_bytes(feb.replace("Otro", "Ñandú").encode("latin-1"))
    (tmp_path / "c.html").write_text("<p>nothing</p>")
    paths = [str(tmp_path / n) for n in ("a_enero.html", "b_febrero.html", "c.html")]
    jobs.run_fees(spark, paths, str(tmp_path / "out"))
    read = lambda sheet: read_sheet(spark, str(tmp_path / "out"), sheet)
    row = read("Resumen_Anual").first()
    assert (row["Rut"], row[fees.NAME], row["Brutos"], row["Meses"]) == ("9.876.543-2", "Muñoz & Cía", 2000, [1, 2])
    assert tuple(read("Declarante").first()) == ("ACME LTDA", "76123456-K")
    assert [tuple(r) for r in read("Rechazados").collect()] == [("c.html", "no table found")]
    assert {r[fees.NAME] for r in read("Detalle_Boletas").collect()} == {"Muñoz & Cía", "Ñandú"}
    assert read("Cuadro_Resumen").count() == 7


def test_rent_job_and_gate(spark, tmp_path):
    header = ",".join(c for c in rent.SHEET_COLUMNS)
    good = ["61", "328", "13101", "Santiago", "1.234.567-8", "", '"500.000"', *[""] * 11, "", "", "x", ""]
    blank = [""] * len(good)
    (tmp_path / "ok.csv").write_text("\n".join([header, ",".join(good), ",".join(blank)]) + "\n")
    jobs.run_rent(spark, str(tmp_path / "ok.csv"), str(tmp_path / "out"), WHO)
    row = read_sheet(spark, str(tmp_path / "out"), "DJ_1835").collect()
    assert len(row) == 1
    assert (row[0]["N°"], row[0]["Monto_Arriendo"], row[0]["Amoblado"], row[0]["DFL2"]) == (1, 518_000, "1", "X")
    bad = ["", "328", "13101", "Santiago", "x", "", *[""] * 12, "5", "", "", ""]
    (tmp_path / "bad.csv").write_text("\n".join([header, ",".join(blank), ",".join(bad)]) + "\n")
    with pytest.raises(ValidationError, match="Fila 2: falta completar el Rol") as caught:
        jobs.run_rent(spark, str(tmp_path / "bad.csv"), str(tmp_path / "out2"), WHO)
    assert {r["rule"] for r in caught.value.issues.collect()} == {"roll", "landlord_rut", "amount", "furnished"}


def test_rent_numbers_are_not_text(spark):
    sheet = spark.sql("SELECT 1L AS row_no, 500000.0D AS Monto_ENE, 1.0D AS Amoblado, '1-9' AS Rut_Arrendador")
    row = rent.base(sheet, PARAMS, apply_index=False).first()
    assert (row["Monto_ENE"], row["Amoblado"], row["Monto_Arriendo"]) == (500_000, "1", 500_000)
    assert {r["rule"] for r in rent.issues(rent.base(sheet), TENANT).collect()} >= {"roll", "commune_code"}


def book_text(rows):
    lines = [";".join(payroll.BOOK_COLUMNS)]
    for worker, end, earnings, tax_paid in rows:
        cells = {payroll.COL_RUT: worker, payroll.COL_CONTRACT_END: end, payroll.COL_EARNINGS: earnings,
                 payroll.COL_TAX: tax_paid}
        lines.append(";".join(cells.get(c, "") for c in payroll.BOOK_COLUMNS))
    return "\n".join(lines) + "\n"


def test_payroll_job_from_files(spark, tmp_path):
    oct_book = book_text([("1.111.111-1", "", "1.000.000", "0"), ("1.111.111-1", "31/10/2025", "50.000,4", "0")])
    nov_book = book_text([("1.111.111-1", "", "1000", "50000")])
    dic_book = book_text([("", "", "2000", "0")])
    (tmp_path / "lre_octubre.csv").write_bytes(b"\xef\xbb\xbf" + oct_book.encode("utf-8"))
    (tmp_path / "lre_noviembre.csv").write_bytes(nov_book.encode("latin-1"))
    (tmp_path / "lre_diciembre.csv").write_bytes(dic_book.encode("utf-8"))
    paths = [str(tmp_path / f"lre_{m}.csv") for m in ("octubre", "noviembre", "diciembre")]
    jobs.run_payroll(spark, paths, str(tmp_path / "out"), WHO)
    base = read_sheet(spark, str(tmp_path / "out"), "Base_LRE_Mensual")
    rows = {(r["Rut_Trabajador"], r["MES_DJ"]): r for r in base.collect()}
    first = rows[("1111111-1", "OCT")]
    assert (first["Renta_Total_Neta_Mensual"], first["Periodo_DJ"], first["ARCHIVO_ORIGEN"]) == (
        1_050_000, "C", "lre_octubre.csv")
    assert rows[("1111111-1", "NOV")]["Metodo_Renta"] == payroll.INFERRED
    assert rows[("", "DIC")]["Renta_Total_Neta_Mensual"] == 2000
    listed = read_sheet(spark, str(tmp_path / "out"), "DJ_1887").orderBy("N°").collect()
    assert [r["Rut_Trabajador"] for r in listed] == ["", "1111111-1"]
    assert read_sheet(spark, str(tmp_path / "out"), "Resumen_1887").count() == 28
    with pytest.raises(ValidationError):
        jobs.run_payroll(spark, [paths[0], paths[2]], str(tmp_path / "out2"), WHO)


def test_file_set_by_mask_or_collected(spark):
    book = spark.createDataFrame(
        [("1-9", "1000", "0", "ENE", f, i) for i, f in enumerate(["b.csv", "a.csv", "b.csv"])],
        "rut string, e string, t string, MES_DJ string, ARCHIVO_ORIGEN string, ord bigint",
    ).toDF(*payroll.REQUIRED_COLUMNS, "MES_DJ", "ARCHIVO_ORIGEN", "ord")
    one = payroll.worker_month(book, PARAMS).collect()
    two = payroll.worker_month(book, PARAMS, files=["a.csv", "b.csv"]).collect()
    assert one == two and one[0]["ARCHIVO_ORIGEN"] == "a.csv | b.csv"


def test_repeated_headers():
    assert header_names("﻿a;b;a;a") == ["a", "b", "a.1", "a.2"]
