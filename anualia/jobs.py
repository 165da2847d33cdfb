"""Complete returns from files to a report bundle.

    spark-submit anualia/jobs.py fees    --out s3a://.../run1 report1.html report2.html
    spark-submit anualia/jobs.py rent    --out s3a://.../run1 --name ... --rut ... sheet.csv
    spark-submit anualia/jobs.py payroll --out s3a://.../run1 --name ... --rut ... lre_enero.csv ... lre_diciembre.csv

Tables that several sheets build on are written once and read back.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from anualia.params import (  # noqa: E402
    DECLARANT_TYPES,
    DEFAULT_YEAR,
    FULL_HOURS_YEARS,
    TENANT,
    Declaration,
    for_year,
)
from anualia.plans import fees, payroll, rent  # noqa: E402
from anualia.scratch import materialize  # noqa: E402
from anualia.sinks.reports import write_bundle  # noqa: E402
from anualia.sources.html_reports import (  # noqa: E402
    fee_receipts,
    last_declarant,
    parse_reports,
    read_pages,
    rejects,
)
from anualia.sources.listing import base_name  # noqa: E402
from anualia.sources.payroll_csv import payroll_book  # noqa: E402
from anualia.sources.rent_sheet import rent_sheet  # noqa: E402


def _sheet(issues: DataFrame, about: str) -> DataFrame:
    """An issue table as rows of the sheet of observations."""
    return issues.select(F.col(about).cast("string").alias("Referencia"), "severity", "rule", "message")


def run_fees(
    spark: SparkSession, paths: list[str], out: str, year: int = DEFAULT_YEAR, fmt: str = "parquet",
    normalize_keys: bool = False,
) -> None:
    """Fee return; unusable files are listed and the others still count."""
    params = for_year(year)
    parsed = materialize(parse_reports(read_pages(spark, paths)), "reports")
    noted, seen = fees.watched(fees.detail(fee_receipts(parsed)))
    lines = materialize(noted, "receipts")
    fees.check_watched(seen, params)
    annual = materialize(fees.annual(lines, params, normalize_keys), "annual")
    observed = _sheet(fees.rut_issues(annual), "Rut").unionByName(_sheet(fees.other_year_issues(lines, year), "Rut"))
    write_bundle(out, {
        "DJ_1879": fees.return_list(annual),
        "Cuadro_Resumen": fees.summary(annual),
        "Resumen_Anual": annual,
        "Detalle_Boletas": lines.drop("ord"),
        "Declarante": last_declarant(parsed.filter("reason IS NULL")),
        "Rechazados": rejects(parsed),
        "Observaciones": observed,
    }, fmt)


def run_rent(
    spark: SparkSession, path: str, out: str, declaration: Declaration, fmt: str = "parquet",
) -> None:
    """Rent return; a declarant who cannot file, or any broken rule, stops it before something is written."""
    who = declaration.checked()
    noted, watch = rent.watched(rent.base(rent_sheet(spark, path), for_year(who.commercial_year), who.apply_index), who.declarant_type)
    base = materialize(noted, "base")
    rent.check_watched(watch, base, who.declarant_type)
    listed = rent.return_list(base, who.declarant_type)
    write_bundle(out, {
        "DJ_1835": listed, "Cuadro_Resumen": rent.summary(listed), "Base_Calculo": base.drop("row_no"),
        "Observaciones": _sheet(rent.issues(base, who.declarant_type), "row_no"),
        "Declarante": who.table(spark),
    }, fmt)


def run_payroll(
    spark: SparkSession, paths: list[str], out: str, declaration: Declaration, fmt: str = "parquet",
    encoding: str | None = None,
) -> None:
    """Payroll return from the monthly books; a declarant who cannot file stops it before a book is read."""
    who = declaration.checked()
    book = payroll_book(spark, paths, encoding)
    names = [base_name(p) for p in paths]
    months = materialize(payroll.worker_month(book, for_year(who.commercial_year), names), "worker-month")
    listed = payroll.return_list(months)
    write_bundle(out, {
        "DJ_1887": listed, "Resumen_1887": payroll.summary(listed), "Base_LRE_Mensual": months,
        "Observaciones": _sheet(payroll.blank_worker_issues(months), "MES_DJ"),
        "Declarante": who.table(spark),
    }, fmt)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("form", choices=["fees", "rent", "payroll"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--out", required=True)
    parser.add_argument("--year", type=int, default=DEFAULT_YEAR)
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--normalize-keys", action="store_true", help="fees: one payee for all spellings of a RUT")
    parser.add_argument("--name", default="", help="rent and payroll: the declarant's name")
    parser.add_argument("--rut", default="", help="rent and payroll: the declarant's RUT")
    parser.add_argument("--declarant-type", default=TENANT, choices=DECLARANT_TYPES)
    parser.add_argument("--no-index", action="store_true")
    parser.add_argument("--full-hours-year", type=int, default=FULL_HOURS_YEARS[-1])
    parser.add_argument("--email", default="")
    parser.add_argument("--address", default="")
    parser.add_argument("--commune", default="")
    args = parser.parse_args(arguments)
    who = Declaration(
        args.name, args.rut, args.year, args.declarant_type, not args.no_index, args.full_hours_year, args.email,
        args.address, args.commune,
    )
    if args.form != "fees":
        who.checked()
    spark = SparkSession.builder.appName(f"annual-return-{args.form}").getOrCreate()
    if args.form == "fees":
        run_fees(spark, args.paths, args.out, args.year, args.format, args.normalize_keys)
    elif args.form == "rent":
        run_rent(spark, args.paths[0], args.out, who, args.format)
    else:
        run_payroll(spark, args.paths, args.out, who, args.format)


if __name__ == "__main__":
    main()
