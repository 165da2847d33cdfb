"""Parameters by year, gates from counts, bundles, file sets, declarants."""

import random

import pytest
from pyspark.sql import functions as F

from anualia import jobs
from anualia.operators.quality import ValidationError
from anualia.params import BRACKETS_2025, FACTORS_2025, UTM_2025, Declaration, for_year, year_parameters
from anualia.plans import fees, payroll, rent
from anualia.scratch import materialize
from anualia.sinks.reports import open_bundle, read_sheet, write_bundle
from anualia.sources.parameters import checked_parameters, parameter_table, unknown_months
from tests.test_rules import receipts, report

WHO = Declaration("Ana", "12.345.678-5")
SHORT = year_parameters(2025, {m: f for m, f in FACTORS_2025.items() if m not in ("NOV", "DIC")}, UTM_2025, BRACKETS_2025)


def jobs_run(spark, action):
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    action()
    ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    spark.sparkContext.setJobGroup("", "")
    return ran


def lines(spark, dates):
    return fees.detail(receipts(spark, [(d, "VIGENTE", f"{i}-9", "Uno", "100", "14", "86") for i, d in enumerate(dates)]))


def test_months_without_factor_are_named_without_a_job(spark):
    noted, seen = fees.watched(lines(spark, ["1/1/2025", "2/12/2025", "x", "3/11/2025", "4/12/2025"]))
    written = materialize(noted, "receipts")

    def ask():
        with pytest.raises(ValidationError, match="NOV, DIC, sin fecha$"):
            fees.check_watched(seen, SHORT)

    assert jobs_run(spark, ask) == 0
    assert {tuple(r) for r in fees.missing_months(written, SHORT).collect()} == {("NOV", 1), ("DIC", 2), ("sin fecha", 1)}
    with pytest.raises(Exception, match="index factor: (NOV|DIC|sin fecha)"):
        fees.annual(written, SHORT).collect()
    noted, seen = fees.watched(lines(spark, ["1/1/2025"]))
    materialize(noted, "receipts")
    fees.check_watched(seen, SHORT)
    noted, seen = fees.watched(lines(spark, []))
    materialize(noted, "receipts")
    fees.check_watched(seen, SHORT)


def test_fee_job_names_the_months(spark, tmp_path, monkeypatch):
    page = report(("02/12/2025", "VIGENTE", "9-1", "A", "1000", "145", "855"), ("nunca", "VIGENTE", "9-1", "A", "1000", "145", "855"))
    (tmp_path / "dic.html").write_text(page)
    monkeypatch.setattr(jobs, "for_year", lambda year: SHORT)
    with pytest.raises(ValidationError, match="DIC, sin fecha"):
        jobs.run_fees(spark, [str(tmp_path / "dic.html")], str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def sheet(spark, bad):
    rows = [(i, "61", "3", "13101", "Stgo", "1.234.567-8", "5000", "9" if i in bad else "1") for i in range(1, 30)]
    return spark.createDataFrame(rows, "row_no long, Rol_Parte_1 string, Rol_Parte_2 string, Codigo_Comuna string, Comuna string, Rut_Arrendador string, Monto_ENE string, Amoblado string")


def test_rent_gate_takes_one_job_less(spark):
    noted, watch = rent.watched(rent.base(sheet(spark, [])))
    base = materialize(noted, "base")
    assert jobs_run(spark, lambda: rent.check_watched(watch, base)) == 0 < jobs_run(spark, lambda: rent.check(base))
    assert watch.rows() == 29 and base.columns == rent.base(sheet(spark, [])).columns
    noted, watch = rent.watched(rent.base(sheet(spark, [4, 8])))
    base = materialize(noted, "base")
    assert watch.broken() == {"furnished": 2}
    with pytest.raises(ValidationError, match="furnished: 2\nFila [48]"):
        rent.check_watched(watch, base)
    noted, watch = rent.watched(rent.base(sheet(spark, []).limit(0)))
    base = materialize(noted, "base")
    with pytest.raises(ValidationError, match="No existen"):
        rent.check_watched(watch, base)


def test_parameters_by_year(spark):
    other = year_parameters(2024, {m: "1.100" for m in FACTORS_2025}, UTM_2025, BRACKETS_2025)
    table = parameter_table(spark, [other, SHORT])
    two = lines(spark, ["1/1/2025", "1/1/2024"])
    rows = fees.annual(two, by_year=table).orderBy("Rut").collect()
    assert [r["Honorarios_Actualizado"] for r in rows] == [15, 15] and unknown_months(two, table, F.col("Fecha")).isEmpty()
    bad = lines(spark, ["1/12/2025", "1/1/2023", "1/2/2024", "x"])
    assert {tuple(r) for r in unknown_months(bad, table, F.col("Fecha")).collect()} == {(2025, 12, 1), (2023, 1, 1), (None, None, 1)}
    with pytest.raises(Exception, match="index factor: (2025-12|2023-01|sin fecha)"):
        fees.annual(bad, by_year=table).collect()
    given = spark.sql("SELECT 2026 AS commercial_year, '3' AS month_no, '1.005' AS factor, '70000' AS utm")
    assert [tuple(r) for r in checked_parameters(given).collect()] == [(2026, 3, 1005, 70000)]
    with pytest.raises(ValidationError, match="2026-3"):
        checked_parameters(given.union(given))
    for plan in (lambda: payroll.lines(spark.range(1), SHORT), lambda: rent.index_amounts(spark.range(1), SHORT)):
        with pytest.raises(ValueError, match="NOV, DIC of 2025"):
            plan()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_bundle_is_seen_whole_or_not_at_all(spark, tmp_path, fmt):
    path = str(tmp_path / "bundle")
    good = spark.range(3).selectExpr("id", "array(id, 2L) AS both", "cast(id AS STRING) AS `Nombre °`")
    killed = spark.range(9).selectExpr("cast(raise_error('killed') AS BIGINT) AS id")
    with pytest.raises(FileNotFoundError):
        open_bundle(spark, path)
    with pytest.raises(Exception, match="killed"):
        write_bundle(path, {"a": good, "b": good, "c": killed}, fmt)
    with pytest.raises(FileNotFoundError):
        open_bundle(spark, path)
    first = write_bundle(path, {"a": good, "b": good.limit(1), "c": good.limit(2)}, fmt)
    with pytest.raises(Exception, match="killed"):
        write_bundle(path, {"a": good.limit(0), "b": good, "c": killed}, fmt)
    assert open_bundle(spark, path).run == first
    assert [read_sheet(spark, path, s).count() for s in "abc"] == [3, 1, 2]
    write_bundle(path, {"a": good.limit(1), "d": good}, fmt)
    assert sorted(open_bundle(spark, path).schemas) == ["a", "d"] and read_sheet(spark, path, "a").count() == 1
    assert read_sheet(spark, path, "d").dtypes == [("id", "bigint"), ("both", "string" if fmt == "csv" else "array<bigint>"), ("Nombre °", "string")]
    with pytest.raises(KeyError, match="no sheet b; there are a, d"):
        read_sheet(spark, path, "b")


def book_of(spark, rows):
    return spark.createDataFrame([(w, "1000", "0", m, f, i) for i, (w, m, f) in enumerate(rows)], "a string, b string, c string, d string, e string, f long").toDF(
        *payroll.REQUIRED_COLUMNS, "MES_DJ", "ARCHIVO_ORIGEN", "ord"
    )


def test_file_sets_of_any_size(spark, monkeypatch):
    rng = random.Random(0)
    names = [f"f{k:03d} 'x'.csv" for k in range(500)]
    rows = [(f"{rng.randrange(20)}-1", rng.choice(["ENE", "FEB"]), rng.choice(names)) for _ in range(3000)] + [("", "ENE", n) for n in names]
    want = {}
    for w, m, f in rows:
        want.setdefault((w, m), set()).add(f)
    want = {k: " | ".join(sorted(v)) for k, v in want.items()}
    book = book_of(spark, rows)

    def found(df):
        return {(r["Rut_Trabajador"], r["MES_DJ"]): r["ARCHIVO_ORIGEN"] for r in df.collect()}

    masks = payroll.worker_month(book, files=names)
    plan = masks._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert found(masks) == found(payroll.worker_month(book)) == want
    monkeypatch.setattr(payroll, "MOST_WORDS", 2)
    assert found(payroll.worker_month(book)) == found(payroll.worker_month(book, files=names)) == want
    with pytest.raises(Exception, match="not in the given list"):
        payroll.worker_month(book, files=names[:9]).collect()
    assert payroll.worker_month(book.limit(0)).count() == 0


def test_declarants_who_cannot_file_are_refused_before_reading(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere.csv")
    for arguments, why in {
        ("rent", nowhere, "--rut", "1.234.567-8"): "name is empty", ("payroll", nowhere, "--name", "Ana", "--rut", "8"): "must look like",
        ("payroll", nowhere, "--name", "Ana", "--rut", "1.234.567-8", "--full-hours-year", "1999"): "40-hour",
    }.items():
        with pytest.raises(ValueError, match=why):
            jobs.main([*arguments, "--out", str(tmp_path / "out")])
    for run in (jobs.run_rent, lambda s, p, o, d: jobs.run_payroll(s, [p], o, d)):
        with pytest.raises(ValueError, match="name is empty"):
            run(spark, nowhere, str(tmp_path / "out"), Declaration(" ", "1.234.567-8"))


def test_observations_are_a_sheet(spark, tmp_path):
    page = report(
        ("02/01/2025", "VIGENTE", "sin numero", "A", "1000", "145", "855"), ("02/01/2024", "VIGENTE", "9-1", "B", "1000", "145", "855"),
        ("02/01/2025", "VIGENTE", "9.1-2", "C", "1000", "145", "855"), ("02/01/2025", "VIGENTE", "91-2", "C", "1000", "145", "855"),
    )
    (tmp_path / "enero.html").write_text(page)
    jobs.main(["fees", str(tmp_path / "enero.html"), "--out", str(tmp_path / "out"), "--normalize-keys"])
    rows = read_sheet(spark, str(tmp_path / "out"), "Observaciones").collect()
    assert {(r["Referencia"], r["rule"]) for r in rows} == {("SINNUMERO", "malformed_rut"), ("9-1", "other_year")}
    assert {r["Rut"] for r in read_sheet(spark, str(tmp_path / "out"), "Resumen_Anual").collect()} == {"SINNUMERO", "9-1", "91-2"}
    text = ",".join(rent.SHEET_COLUMNS) + "\n" + "61,328,13101,Stgo,1.234.567-8,,500," + "," * 14 + "\n"
    (tmp_path / "sheet.csv").write_text(text)
    jobs.run_rent(spark, str(tmp_path / "sheet.csv"), str(tmp_path / "rent"), WHO)
    assert read_sheet(spark, str(tmp_path / "rent"), "Observaciones").count() == 0
    assert read_sheet(spark, str(tmp_path / "rent"), "Declarante").first()["Anio_Tributario"] == for_year().tax_year
