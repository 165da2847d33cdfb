"""One query per operator or pipeline; each reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anualia.functions import amounts, months, rut, tax
from anualia.operators.conform import quoted, union_by_name
from anualia.operators.quality import month_coverage, rule_counts
from anualia.operators.sequence import number_rows
from anualia.params import INTERMEDIARY, for_year
from anualia.plans import fees, payroll, rent
from anualia.scratch import materialize, new_path
from anualia.sinks.reports import open_bundle, read_sheet, write_bundle
from anualia.sources import html_reports
from anualia.sources.parameters import parameter_table, unknown_months, with_parameters
from anualia.sources.payroll_csv import book_rejects, payroll_book
from anualia.sources.rent_sheet import rent_sheet
from workload import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

PLAIN_NAMES = {
    fees.NAME: "Nombre",
    "N°": "Numero",
    "Número Certificado": "Numero_Certificado",
    fees.FEE_HEADING: "Honorarios_Actualizado",
    fees.LOAN_HEADING: "Prestamo_3_Actualizado",
}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def plain(df: DataFrame) -> DataFrame:
    """Column names in ASCII; the list of months as text."""
    if "Meses" in df.columns:
        df = df.withColumn("Meses", F.concat_ws(",", F.col("Meses").cast("array<string>")))
    return df.withColumnsRenamed({k: v for k, v in PLAIN_NAMES.items() if k in df.columns})


# ---- sources -----------------------------------------------------------------


@query
def html_cell_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every list on every page."""
    pages = a.table(spark, sf_dir, "pages").select("page_id", "html")
    return html_reports.html_cells(pages, ["page_id"], "ul", "li")


@query
def fee_report_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts read back from fee reports in markup, with their declarant."""
    parsed = html_reports.parse_reports(a.report_pages(spark, sf_dir))
    return plain(fees.detail(html_reports.fee_receipts(parsed))).drop("ord")


@query
def fee_report_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that cannot be used."""
    return html_reports.rejects(html_reports.parse_reports(a.report_pages(spark, sf_dir)))


@query
def fee_report_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of reports whose cells span rows and columns."""
    parsed = html_reports.parse_reports(a.spanned_pages(spark, sf_dir))
    return plain(fees.detail(html_reports.fee_receipts(parsed))).drop("ord")


@query
def fee_report_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of reports with tables inside cells."""
    parsed = html_reports.parse_reports(a.nested_pages(spark, sf_dir))
    return plain(fees.detail(html_reports.fee_receipts(parsed))).drop("ord")


@query
def month_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month told by a file name; the first name in calendar order wins."""
    orders = a.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"""concat(
        IF(o_orderkey % 7 = 0, 'libro_mayor_', 'Libro_'),
        CASE WHEN o_orderkey % 10 = 0 THEN 'resumen'
             WHEN o_orderkey % 10 = 1 AND month(o_orderdate) = 9 THEN 'SETIEMBRE'
             ELSE {a.month_word('o_orderdate')} END,
        '_', o_orderkey, '.csv') AS file""")
    return orders.withColumn("month", months.month_from_name(F.col("file")))


def _contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = a.dotted("s_suppkey % 80000000 + 10000000")
    suppliers = a.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "s_nationkey", "s_suppkey AS file_no",
        f"""concat('Informe 2025 contribuyente: ', IF(s_suppkey % 9 = 0, '?', replace(s_name, '#', ' ')),
            '  Rut: ', IF(s_suppkey % 7 = 0, 'sin numero',
                concat({number}, ' - ', lower({a.check_char('s_suppkey')}))), ' fin') AS text""",
    )
    return suppliers.select(
        "s_suppkey", "s_nationkey", "file_no",
        html_reports.contributor_name(F.col("text")).alias("Nombre_Empresa_Declarante"),
        html_reports.contributor_rut(F.col("text")).alias("Rut_Empresa_Declarante"),
    )


@query
def contributor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarant's name and RUT out of running text."""
    return _contributors(spark, sf_dir).drop("file_no", "s_nationkey")


@query
def last_declarant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last known declarant over files in order, per nation."""
    return html_reports.last_declarant(_contributors(spark, sf_dir), ["s_nationkey"])


@query
def payroll_book_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly payroll books written as CSV folders and read back with all checks."""
    book = a.payroll_book(spark, sf_dir)
    word = months.pick(a.MONTH_WORDS, months.month_number(F.col("MES_DJ")))
    path = new_path(spark, "books")
    book.select(*[quoted(c) for c in payroll.BOOK_COLUMNS], F.concat(F.lit("lre_"), word).alias("book")).write.partitionBy(
        "book"
    ).option("sep", ";").option("header", True).csv(path)
    read = payroll_book(spark, [f"{path}/book=lre_{w}" for w in a.MONTH_WORDS])
    return read.select(
        quoted(payroll.COL_RUT).alias("rut"), quoted(payroll.COL_CONTRACT_END).alias("contract_end"),
        quoted(payroll.COL_EARNINGS).alias("earnings"), quoted(payroll.COL_TAX).alias("tax"),
        quoted(payroll.COL_EMPLOYER).alias("employer"), F.col("MES_DJ").alias("month"),
        F.col("ARCHIVO_ORIGEN").alias("file"),
    )


@contextmanager
def split_size(spark: SparkSession, size: str) -> Iterator[None]:
    """Files are read in splits of this size."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _book_paths(path: str) -> list[str]:
    return [f"{path}/book=lre_{w}" for w in a.MONTH_WORDS]


@query
def payroll_book_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payroll books with line breaks inside cells, read back record by record from many splits."""
    book = a.quoted_book(spark, sf_dir).select(*[quoted(c) for c in payroll.BOOK_COLUMNS], a.book_word().alias("book"))
    path = new_path(spark, "quoted-books")
    book.write.partitionBy("book").option("sep", ";").option("escape", '"').option("header", True).csv(path)
    with split_size(spark, "64k"):
        return materialize(payroll_book(spark, _book_paths(path)).select(
            quoted(payroll.COL_RUT).alias("rut"), quoted(payroll.COL_CONTRACT_END).alias("contract_end"),
            quoted(payroll.COL_EARNINGS).alias("earnings"), quoted(payroll.COL_EMPLOYER).alias("employer"),
            F.col("MES_DJ").alias("month"), F.col("ARCHIVO_ORIGEN").alias("file"),
        ), "quoted-book")


@query
def payroll_book_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of payroll books with more cells than the header."""
    path = new_path(spark, "ragged-books")
    lines = a.ragged_lines(spark, sf_dir)
    lines.repartition("book", "part").sortWithinPartitions("book", "part", "ord").select("book", "part", "value").write.partitionBy("book", "part").text(path)
    found = book_rejects(spark, _book_paths(path))
    return found.select(F.col("file_name").alias("file"), "cells", "expected", F.split("record", ";")[0].alias("rut"))


@query
def payroll_book_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payroll books in more than a thousand files, listed, looked at and read in a fixed number of jobs."""
    book = a.payroll_book(spark, sf_dir).select(*[quoted(c) for c in payroll.BOOK_COLUMNS], a.book_word().alias("book"))
    path = new_path(spark, "many-books")
    book.repartition(96).write.partitionBy("book").option("sep", ";").option("header", True).csv(path)
    read = payroll_book(spark, _book_paths(path))
    return read.select(quoted(payroll.COL_RUT).alias("rut"), quoted(payroll.COL_TAX).alias("tax"), F.col("MES_DJ").alias("month"))


@query
def union_of_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two books with different columns stacked by name."""
    book = a.payroll_numbers(spark, sf_dir)
    first = book.filter(F.col("month_no") <= 6).select("o_orderkey", "earnings", "tax")
    second = book.filter(F.col("month_no") > 6).select("loan", "o_orderkey", "earnings")
    return union_by_name([first, second])


@query
def report_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee list written as one sheet of a bundle and read back."""
    annual = fees.annual(fees.detail(a.receipts(spark, sf_dir)))
    path = new_path(spark, "bundle")
    write_bundle(path, {"Resumen_Anual": plain(annual)}, "csv")
    return read_sheet(spark, path, "Resumen_Anual").select("Rut", "Nombre", "Brutos", "Honorarios_Actualizado", "Meses")


@query
def report_bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sheets of the latest of two bundles under one path, read through the manifest."""
    path = new_path(spark, "bundle")
    lines = fees.detail(a.receipts(spark, sf_dir))
    annual = materialize(fees.annual(lines), "annual")
    write_bundle(path, {"Cuadro_Resumen": fees.summary(annual.limit(1))})
    write_bundle(path, {
        "Cuadro_Resumen": fees.summary(annual), "Resumen_Anual": plain(annual), "Detalle_Boletas": plain(lines.drop("ord")),
    })
    bundle = open_bundle(spark, path)
    rows = [
        bundle.sheet(spark, "Cuadro_Resumen").select(F.lit("Cuadro_Resumen").alias("sheet"), F.col("Campo").alias("key"), F.col("Monto").alias("amount")),
        bundle.sheet(spark, "Resumen_Anual").select(F.lit("Resumen_Anual").alias("sheet"), F.col("Rut").alias("key"), F.col("Brutos").alias("amount")),
        bundle.sheet(spark, "Detalle_Boletas").select(F.lit("Detalle_Boletas").alias("sheet"), F.col("Rut").alias("key"), F.col("Retenido").alias("amount")),
    ]
    return union_by_name(rows)


@query
def rent_sheet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rental sheet written as CSV and read back: places of rows, rows without a value dropped."""
    path = new_path(spark, "sheet")
    a.blank_sheet(spark, sf_dir).write.option("header", True).csv(path)
    return rent.conform(rent_sheet(spark, path)).select(
        "row_no", "Rol_Parte_1", "Rol_Parte_2", "Comuna", "Rut_Arrendador", "Monto_ENE", "Amoblado", "DFL2"
    )


@query
def book_required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three books, and the compulsory columns for whose lack a book is refused."""
    book = a.payroll_book(spark, sf_dir)
    rows = []
    for label, absent in (("whole", []), ("no tax", [payroll.COL_TAX]), ("no worker, no tax", [payroll.COL_RUT, payroll.COL_TAX])):
        cut = book.drop(*absent)
        try:
            refused = payroll.amounts(cut) and ""
        except ValueError as error:
            refused = str(error)
        rows.append(cut.groupBy("MES_DJ").agg(F.count("*").alias("rows")).select(F.lit(label).alias("book"), "MES_DJ", "rows", F.lit(refused).alias("refused")))
    return union_by_name(rows)


# ---- scalar functions --------------------------------------------------------


@query
def amount_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee-report amounts in several notations."""
    return _amount_query(spark, sf_dir, amounts.coerce_integer)


@query
def amount_clean_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rental-sheet amounts in several notations."""
    return _amount_query(spark, sf_dir, amounts.clean_amount_plain)


@query
def amount_clean_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payroll amounts in several notations."""
    return _amount_query(spark, sf_dir, amounts.clean_amount_locale)


def _amount_query(spark: SparkSession, sf_dir: str, clean: Callable[[str], Column]) -> DataFrame:
    dots = a.dotted("w")
    shapes = [
        "NULL", "' - '", "concat(' ', w, ' ')", "concat(w, '.00')", f"concat('$ ', {dots}, ',', cents)", dots,
        "format_number(w, 0)", "concat(w, '.', cents)", "concat(w, ',', cents)", "concat(w, '.5')",
        "concat('-', w, '.000')", f"concat('-', {dots})", "concat('n', w)", "concat(w, 'e1')",
    ]
    arms = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes))
    lines = a.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "floor(l_extendedprice) AS w",
        "lpad(string(l_orderkey % 100), 2, '0') AS cents",
    )
    texts = lines.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        f"CASE (l_orderkey + l_linenumber) % {len(shapes)} {arms} END AS text",
    )
    return texts.withColumn("amount", clean("text"))


@query
def rut_normalize_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, shape check and order key of the landlords' ids."""
    sheet = a.rental_sheet(spark, sf_dir).select("row_no", "Rut_Arrendador")
    raw = F.col("Rut_Arrendador")
    return sheet.select(
        "row_no", rut.normalize_rut(raw).alias("rut"), rut.rut_is_valid(raw).alias("valid"),
        rut.rut_order(raw).alias("rut_order"), rut.rut_order_raw(raw).alias("rut_order_raw"),
    )


@query
def amount_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as shown, with dots between thousands."""
    orders = a.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "IF(o_orderkey % 6 <> 0, floor(o_totalprice) * (o_orderkey % 3 - 1), NULL) AS amount"
    )
    return orders.select("o_orderkey", amounts.format_amount(F.col("amount")).alias("shown"))


@query
def receipt_date_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt dates with and without leading zeros, and bad ones."""
    orders = a.table(spark, sf_dir, "orders").selectExpr("o_orderkey", """CASE o_orderkey % 5
        WHEN 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 1 THEN date_format(o_orderdate, 'd/M/yyyy')
        WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd')
        WHEN 3 THEN concat('31/', date_format(o_orderdate, 'MM/yyyy')) END AS text""")
    return orders.withColumn("date", months.receipt_date(F.col("text"))).withColumn("month_no", F.month("date"))


@query
def receipt_tax_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts and withholdings by the year in which they are declared."""
    lines = fees.detail(a.receipts(spark, sf_dir))
    return lines.groupBy(months.tax_year(F.col("Fecha")).alias("tax_year")).agg(F.count("*").alias("receipts"), F.sum("Retenido").alias("withheld"))


# ---- fees --------------------------------------------------------------------


@query
def status_and_withholding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid receipts with a positive withholding, typed."""
    return plain(fees.detail(a.receipts(spark, sf_dir)))


@query
def withholding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, excess, loan and fee share of every valid receipt."""
    return fees.split(fees.detail(a.receipts(spark, sf_dir))).select(
        "ord", "Brutos", "Retenido", "Retenido_Base_145", "Exceso_Retencion", "Retenido_Prestamo_3",
        "Retenido_Honorarios",
    )


@query
def fee_sum_then_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restated withholding per payee, summed exactly and rounded once."""
    annual = fees.annual(fees.detail(a.receipts(spark, sf_dir)))
    return annual.select("Rut", "Honorarios_Actualizado", "Prestamo_3_Actualizado")


@query
def fee_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly figures per payee."""
    return plain(fees.annual(fees.detail(a.receipts(spark, sf_dir))))


@query
def fee_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fee list to declare."""
    return plain(fees.return_list(fees.annual(fees.detail(a.receipts(spark, sf_dir)))))


@query
def fee_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the fee return."""
    return fees.summary(fees.annual(fees.detail(a.receipts(spark, sf_dir))))


@query
def fee_other_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts dated outside the commercial year."""
    return fees.other_year_issues(fees.detail(a.receipts(spark, sf_dir)), 1997)


@query
def fee_missing_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts whose date cannot be read, hence without a factor."""
    bad = F.expr("IF(ord % 10 = 0, 'sin fecha', Fecha)")
    return fees.missing_factor_issues(fees.detail(a.receipts(spark, sf_dir).withColumn("Fecha", bad)))


@query
def fee_missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of receipts for which no factor is published yet, and receipts without a date."""
    bad = F.expr("IF(ord % 10 = 0, 'sin fecha', Fecha)")
    lines = fees.detail(a.receipts(spark, sf_dir).withColumn("Fecha", bad))
    return fees.missing_months(lines, a.years_of_orders()[1])


@query
def parameter_join_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts restated with the factor of their own year and month."""
    table = parameter_table(spark, a.years_of_orders())
    lines = fees.detail(a.receipts(spark, sf_dir)).select("ord", "Fecha", "Retenido")
    joined = with_parameters(lines, table, F.col("Fecha"))
    return joined.select(
        "ord", "commercial_year", "month_no", "utm", amounts.half_up(F.col("Retenido") * F.col("factor_milli"), 1000).alias("restated")
    )


@query
def parameter_unknown_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years and months of receipts that no registered year has a factor for."""
    lines = fees.detail(a.receipts(spark, sf_dir))
    return unknown_months(lines, parameter_table(spark, a.years_of_orders()), F.col("Fecha"))


# ---- rent --------------------------------------------------------------------


@query
def rent_conform_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns, cleaned, with default codes; one column is absent."""
    return rent.conform(a.rental_sheet(spark, sf_dir).drop("Monto_DIC"))


@query
def rent_index_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restated months, rounded before the sum, and month flags."""
    return rent.base(a.rental_sheet(spark, sf_dir)).select(
        "row_no", *rent.INDEXED_COLUMNS, "Monto_Arriendo", *months.MONTHS
    )


@query
def rent_index_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months taken as they are."""
    return rent.base(a.rental_sheet(spark, sf_dir), apply_index=False).select(
        "row_no", *rent.INDEXED_COLUMNS, "Monto_Arriendo"
    )


@query
def rent_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules, for a tenant."""
    return rent.issues(rent.base(a.rental_sheet(spark, sf_dir)))


@query
def rent_issues_intermediary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules, for an intermediary, who must name the tenant too."""
    return rent.issues(rent.base(a.rental_sheet(spark, sf_dir)), INTERMEDIARY)


@query
def rent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate of the rent return counts: errors by rule, for an intermediary."""
    return rule_counts(rent.issues(rent.base(a.rental_sheet(spark, sf_dir)), INTERMEDIARY))


@query
def rent_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered list of properties, declared by a tenant."""
    return rent.display_roll(plain(rent.return_list(rent.base(a.rental_sheet(spark, sf_dir)))))


@query
def rent_return_intermediary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered list of properties, declared by an intermediary."""
    return plain(rent.return_list(rent.base(a.rental_sheet(spark, sf_dir)), INTERMEDIARY))


@query
def rent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the rent return."""
    base = rent.base(a.rental_sheet(spark, sf_dir))
    return rent.summary(base.filter(F.col("Monto_Arriendo") > 0))


# ---- payroll -----------------------------------------------------------------


def _books_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an uploaded monthly file of its customer; some names tell no month."""
    names = a.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey",
        f"IF(o_orderkey % 40 = 0, 'libro.csv', concat('lre_', {a.month_word('o_orderdate')}, '.csv')) AS file",
    )
    return names.select("o_custkey", months.month_from_name(F.col("file")).alias("month"))


@query
def month_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First month, months present and months missing up to December."""
    return month_coverage(_books_of_customers(spark, sf_dir), ["o_custkey"]).select(
        "o_custkey", "first_month", "present", "missing"
    )


@query
def month_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months given more than once and files without a month."""
    return month_coverage(_books_of_customers(spark, sf_dir), ["o_custkey"]).select(
        "o_custkey", "duplicated", "undetected"
    )


@query
def tax_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wage tax on a month's income."""
    return a.payroll_numbers(spark, sf_dir).select("o_orderkey", "month", "earnings", "contributions", "tax")


@query
def tax_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income inferred from a tax amount."""
    taxes = _monthly(spark, sf_dir, "floor(o_totalprice) - 5000 AS tax")
    return taxes.select("o_orderkey", "tax", tax.tax_inverse("tax", "utm", for_year()).alias("income"))


@query
def tax_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax of the income inferred from a tax; it must be that tax again."""
    taxes = _monthly(spark, sf_dir, "floor(o_totalprice) AS tax")
    incomes = taxes.withColumn("income", tax.tax_inverse("tax", "utm", for_year()))
    return incomes.select("o_orderkey", "tax", tax.tax_forward("income", "utm", for_year()).alias("again"))


def _monthly(spark: SparkSession, sf_dir: str, amount: str) -> DataFrame:
    utm = tax.utm_sql("month(o_orderdate)", for_year())
    return a.table(spark, sf_dir, "orders").selectExpr("o_orderkey", amount, f"{utm} AS utm")


@query
def tax_bracket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket of a month's income by range join."""
    df = a.payroll_numbers(spark, sf_dir).select("o_orderkey", "month", "earnings")
    return tax.join_bracket(df, "earnings", "month", for_year()).select(
        "o_orderkey", "month", "earnings", "factor_milli", "rebate_cents"
    )


@query
def month_parameter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor and UTM of the month by broadcast join to the twelve parameter rows."""
    df = a.payroll_numbers(spark, sf_dir).select("o_orderkey", "month", "earnings")
    joined = df.join(F.broadcast(for_year().month_table(spark)), "month", "left")
    restated = amounts.round_peso_or_zero(F.col("earnings").cast("decimal(18,0)") * F.col("factor"))
    return joined.select("o_orderkey", "month", "utm", restated.alias("restated"))


@query
def payroll_net_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback, inferred and chosen income of every line, with the method."""
    return payroll.lines(a.payroll_book(spark, sf_dir)).select(
        "ord", "Renta_LRE_Fallback", "IUSC_Total_Mensual", "Renta_Inferida_IUSC", "Renta_Total_Neta_Mensual",
        "Metodo_Renta", "Renta_No_Gravada_Mensual", "Renta_Exenta_Mensual",
        "Monto_Ingreso_Mensual_Sin_Actualizar", "Leyes_Sociales", *payroll.RESTATED,
    )


@query
def payroll_period_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract end, hours code and period of every line."""
    return payroll.lines(a.payroll_book(spark, sf_dir)).select(
        "ord", "Tiene_Termino", "Horas_Semanales", "Periodo_DJ"
    )


@query
def payroll_optional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book with the compulsory columns only: all other amounts are 0."""
    book = a.payroll_book(spark, sf_dir).select(
        *[quoted(c) for c in payroll.REQUIRED_COLUMNS], "MES_DJ", "ARCHIVO_ORIGEN", "ord"
    )
    return payroll.lines(book).select(
        "ord", "Renta_Total_Neta_Mensual", "Leyes_Sociales", "Tiene_Termino", "Horas_Semanales", "Periodo_DJ"
    )


@query
def payroll_worker_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per worker and month."""
    return payroll.worker_month(a.payroll_book(spark, sf_dir), files=a.BOOK_FILES)


@query
def payroll_file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker-months with their source files, out of some five hundred."""
    named = F.expr("replace(ARCHIVO_ORIGEN, '.csv', concat('_', ord % 42, '.csv'))")
    book = a.payroll_book(spark, sf_dir).withColumn("ARCHIVO_ORIGEN", named)
    return payroll.worker_month(book).select("Rut_Trabajador", "MES_DJ", "ARCHIVO_ORIGEN", "IUSC")


@query
def payroll_period_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One period column per month."""
    base = payroll.worker_month(a.payroll_book(spark, sf_dir), files=a.BOOK_FILES)
    return base.groupBy("Rut_Trabajador").agg(*payroll.period_pivot()).withColumns(payroll.period_texts())


@query
def payroll_income_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One income column per month."""
    base = payroll.worker_month(a.payroll_book(spark, sf_dir), files=a.BOOK_FILES)
    return base.groupBy("Rut_Trabajador").agg(*payroll.income_pivot())


@query
def payroll_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered list of workers."""
    return plain(payroll.return_list(payroll.worker_month(a.payroll_book(spark, sf_dir), files=a.BOOK_FILES)))


@query
def payroll_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28 totals of the payroll return."""
    base = payroll.worker_month(a.payroll_book(spark, sf_dir), files=a.BOOK_FILES)
    return payroll.summary(payroll.consolidate(base))


@query
def payroll_blank_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker-months without a worker id."""
    base = payroll.worker_month(a.payroll_book(spark, sf_dir), files=a.BOOK_FILES)
    return payroll.blank_worker_issues(base)


@query
def range_sequence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running number over all receipts by RUT and order."""
    receipts = a.receipts(spark, sf_dir).select("Rut", "ord")
    return number_rows(receipts, [rut.rut_order(F.col("Rut")), F.col("Rut"), F.col("ord")], "n")
