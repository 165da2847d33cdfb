"""The three inputs (receipts, rental sheet, payroll book) derived from the given tables.

Every row of the source tables takes part. Values are integers from the first
step on, so results do not depend on the order of float additions.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anualia.functions.months import MONTH_NAMES, MONTHS
from anualia.functions.tax import tax_forward, utm_sql
from anualia.functions.template import name
from anualia.params import BRACKETS_2025, FACTORS_2025, UTM_2025, YearParameters, for_year, year_parameters
from anualia.plans import payroll, rent
from anualia.plans.fees import NAME

MONTH_WORDS = [word for word in MONTH_NAMES if word != "setiembre"]
BOOK_FILES = [f"lre_{word}_{part}.csv" for word in MONTH_WORDS for part in range(3)]

# Reports parsed by one task; a join leaves tasks of so many bytes, which is far more reports.
REPORTS_A_TASK = 20_000
# Suppliers that may be broadcast; at some 50 bytes a row this is 25 MB.
BROADCAST_PLACES = 500_000


def table(spark: SparkSession, sf_dir: str, table_name: str) -> DataFrame:
    """A source table; one stored in fewer splits than there are cores is spread out.

    A large table has far more splits than cores and is read as it lies, without
    a shuffle. A file with a single row group would leave all but one core idle.
    """
    df = spark.read.parquet(f"{sf_dir}/{table_name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dotted(value: str) -> str:
    """Whole number with dots between thousands."""
    return f"translate(format_number({value}, 0), ',', '.')"


def check_char(key: str) -> str:
    return f"substring('0123456789K', cast({key} % 11 + 1 AS INT), 1)"


def rut_text(key: str, span: int, start: int) -> str:
    return f"concat({key} % {span} + {start}, '-', {check_char(key)})"


def month_word(date: str) -> str:
    return f"get(array{tuple(MONTH_WORDS)}, month({date}) - 1)"


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee receipts: one per order, payee = customer."""
    base = "((_gross * 145 + 500) DIV 1000)"
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "o_orderkey", "o_orderdate", "floor(o_totalprice) AS _gross",
        "CASE o_orderstatus WHEN 'O' THEN 'VIGENTE' WHEN 'F' THEN 'ANULADA' WHEN 'P' THEN 'Totales* :' END AS Estado",
    )
    rows = orders.selectExpr(
        "*",
        f"CASE o_orderkey % 4 WHEN 0 THEN 0L WHEN 1 THEN {base} ELSE {base} + (_gross * 30) DIV 1000 END AS _held",
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return rows.join(customer, rows.o_custkey == customer.c_custkey).selectExpr(
        "date_format(o_orderdate, 'dd/MM/yyyy') AS Fecha",
        "Estado",
        f"{rut_text('o_custkey', 80_000_000, 10_000_000)} AS Rut",
        f"IF(month(o_orderdate) % 2 = 0, upper(c_name), c_name) AS {name(NAME)}",
        "IF(o_orderkey % 5 = 0, format_number(_gross, 0), cast(_gross AS STRING)) AS Brutos",
        "cast(_held AS STRING) AS Retenido",
        "cast(_gross - _held AS STRING) AS Pagado",
        "concat('m', month(o_orderdate)) AS Archivo_Origen",
        "o_orderkey AS ord",
    )


def spread_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts dealt to tasks that grow in number with the receipts, for a costly step on each row."""
    tasks = -(-spark.read.parquet(f"{sf_dir}/orders.parquet").count() // REPORTS_A_TASK)
    return receipts(spark, sf_dir).repartition(max(tasks, spark.sparkContext.defaultParallelism), "ord")


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee reports as markup: one small report per receipt, some of them unusable."""
    cells = ["ord", "Fecha", "Estado", "Rut", name(NAME), "Brutos", "Retenido", "Pagado"]
    row = ", ".join(f"'<td class=x>', {c}, '</td>'" for c in cells)
    html = f"""concat(
        '<html><body><!-- <table><tr><td>old</td></tr></table> -->',
        '<table border=1><tr><td colspan=8>Contribuyente: ', replace(upper({name(NAME)}), '#', ' '),
        '</td></tr>\n<tr><td>RUT&nbsp;: ', Rut, '</td></tr>\n',
        '<tr><td>N&deg;</td><td>Fecha</td><td>&nbsp;', IF(ord % 50 = 0, 'Situacion', 'Estado'),
        '</td><td>Rut</td><td><b>Nombre&nbsp;o Raz&oacute;n Social</b></td>',
        '<td>Brutos</td><td>Retenido</td><td>Pagado</td></tr>\n',
        '<tr>', {row}, '</tr>\n',
        '<tr><td colspan=5>Totales* :</td><td>1</td><td>1</td><td>1</td></tr></table></body></html>')"""
    return spread_receipts(spark, sf_dir).selectExpr(
        "concat('r', ord) AS file", "ord AS file_no",
        f"IF(ord % 77 = 0, concat('<p>', Rut, '</p>'), {html}) AS html",
    )


def _report(spark: SparkSession, sf_dir: str, html: str) -> DataFrame:
    return spread_receipts(spark, sf_dir).selectExpr("concat('r', ord) AS file", "ord AS file_no", f"concat({html}) AS html")


_REPORT_HEAD = """'<tr><td>N&deg;</td><td>Fecha</td><td>Estado</td><td>Rut</td><td>Nombre o Raz&oacute;n Social</td>',
    '<td>Brutos</td><td>Retenido</td><td>Pagado</td></tr>'"""
_DECLARANT = f"'Contribuyente: ', replace(upper({name(NAME)}), '#', ' '), '  RUT ', Rut"


def spanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee reports with two receipts each, whose date, status, payee and name are cells over two rows.

    The declarant's cell goes over both rows above the header, and the name over a column more.
    """
    again = "cast(cast(translate(Brutos, ',', '') AS BIGINT) + 1 AS STRING)"
    paid = "cast(cast(Pagado AS BIGINT) + 1 AS STRING)"
    return _report(spark, sf_dir, f"""
        '<table><tr><td rowspan="2" colspan=4>', {_DECLARANT}, '</td><td colspan=5>x</td></tr><tr><td>y</td></tr>',
        replace(concat({_REPORT_HEAD}), '<td>Brutos', '<td>Giro</td><td>Brutos'),
        '<tr><td>1</td><td rowspan=2>', Fecha, '</td><td ROWSPAN="2">', Estado, '</td><td rowspan=2>', Rut,
        '</td><td rowspan=2 colspan=2>', {name(NAME)}, '</td><td>', Brutos, '</td><td>', Retenido, '</td><td>', Pagado, '</td></tr>',
        '<tr><td>2</td><td>', {again}, '</td><td>', Retenido, '</td><td>', {paid}, '</td></tr>',
        '<tr><td colspan=6>Totales* :</td><td>1</td><td>1</td><td rowspan=2>1</td></tr></table>'""")


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee reports with tables in their cells, before the header, around the name and after the amounts."""
    return _report(spark, sf_dir, f"""
        '<div><table></table></div><table class=outer><tr><td><table><tr><td>', {_DECLARANT}, '</td></tr></table></td></tr><tr><td>y</td></tr>',
        {_REPORT_HEAD}, '<tr><td>1</td><td>', Fecha, '</td><td>', Estado, '</td><td>', Rut,
        '</td><td><table><tr><td><TABLE><tr><td>', {name(NAME)}, '</td></tr></TABLE></td></tr></table></td><td>', Brutos,
        '</td><td><table><tr><th>', Retenido, '</th></tr></table></td><td>', Pagado,
        '<table><tr></tr></table></td></tr></table><table><tr><td>Fecha</td></tr></table>'""")


def years_of_orders() -> list[YearParameters]:
    """Two made-up parameter years of the orders; the later one still lacks its last two months."""
    earlier = year_parameters(1996, {m: str(Decimal(f) + Decimal("0.010")) for m, f in FACTORS_2025.items()}, {m: u - 9000 for m, u in UTM_2025.items()}, BRACKETS_2025)
    published = MONTHS[:10]
    later = year_parameters(
        1997, {m: str(Decimal(FACTORS_2025[m]) + Decimal("0.005")) for m in published}, {m: UTM_2025[m] - 4000 for m in published}, BRACKETS_2025
    )
    return [earlier, later]


def blank_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rental sheet as text in which every seventh property is followed by a row without any value."""
    sheet = rental_sheet(spark, sf_dir)
    columns = [f"cast({name(c)} AS STRING) AS {name(c)}" for c in rent.SHEET_COLUMNS]
    rows = sheet.selectExpr("row_no", "0 AS after", *columns)
    blank = sheet.where("Rol_Parte_2 % 7 = 0").selectExpr("row_no", "1 AS after", *[f"cast(NULL AS STRING) AS {name(c)}" for c in rent.SHEET_COLUMNS])
    return rows.unionByName(blank).orderBy("row_no", "after").drop("row_no", "after")


def rental_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rental sheet as text: one property per supplier and part."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey", "l_partkey", "floor(l_extendedprice) AS _rent", "month(l_shipdate) AS _m"
    )
    properties = lines.groupBy("l_suppkey", "l_partkey").agg(
        *[F.expr(f"sum(CASE WHEN _m = {i + 1} THEN _rent END) AS _m{i + 1}") for i in range(12)]
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Wide rows stay where they are grouped: the places are broadcast, unless there are very many.
    places = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    few = supplier.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    placed = properties.join(F.broadcast(places) if few else places, properties.l_suppkey == places.s_suppkey)
    landlord = f"concat(' ', {dotted('l_suppkey % 80000000 + 10000000')}, '-', lower({check_char('l_suppkey')}))"
    return placed.selectExpr(
        "l_partkey * 10000000 + l_suppkey AS row_no",
        "IF(l_partkey % 101 = 0, '', cast(l_partkey % 97 AS STRING)) AS Rol_Parte_1",
        "cast(l_partkey AS STRING) AS Rol_Parte_2",
        "CASE WHEN l_partkey % 103 <> 0 THEN cast(n_nationkey + 13100 AS STRING) END AS Codigo_Comuna",
        "IF(l_partkey % 107 = 0, ' ', concat(n_name, ' ')) AS Comuna",
        f"IF(l_partkey % 109 = 0, 'sin rut', {landlord}) AS Rut_Arrendador",
        f"CASE WHEN l_partkey % 4 <> 0 THEN {rut_text('l_partkey', 9_000_000, 1_000_000)} END AS Rut_Arrendatario",
        *[
            f"IF(l_partkey % 137 = 0, '0', {dotted(f'_m{i + 1}')}) AS Monto_{m}" for i, m in enumerate(MONTHS)
        ],
        "CASE WHEN l_partkey % 113 = 0 THEN '9' WHEN l_partkey % 3 <> 0 THEN '2' END AS Amoblado",
        "CASE WHEN l_partkey % 127 = 0 THEN '7' WHEN l_partkey % 4 = 0 THEN ''"
        " ELSE cast(l_partkey % 6 + 1 AS STRING) END AS Destino_Arriendo",
        "CASE WHEN l_partkey % 2 = 0 THEN ' x ' END AS DFL2",
        "CASE WHEN l_partkey % 131 = 0 THEN 'x' WHEN l_partkey % 5 = 0 THEN '  ' ELSE '1' END AS Naturaleza_Bien_Raiz",
    )


def payroll_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payroll figures as integers, one line per order, before they become text."""
    params = for_year()

    def some(n: int, value: str, alias: str) -> str:
        return f"IF(o_orderkey % {n} = 0, {value}, 0L) AS {alias}"

    figures = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "month(o_orderdate) AS month_no", "floor(o_totalprice) AS price",
        f"{month_word('o_orderdate')} AS word",
    ).selectExpr("*", "price * 30 AS earnings", "(price * 30) DIV 5 AS contributions")
    based = figures.selectExpr(
        "*", "earnings - contributions AS _base", f"{utm_sql('month_no', params)} AS _utm",
        f"get(array{MONTHS}, month_no - 1) AS month",
    )
    return based.select("*", tax_forward("_base", "_utm", params).alias("tax")).selectExpr(
        "o_orderkey", "o_custkey", "month_no", "word", "price", "earnings", "contributions", "month", "tax",
        some(29, "o_orderkey % 1000 + 12345", "severance_tax"),
        some(31, "1000L", "backpay_tax"),
        some(37, "-500L", "difference_tax"),
        some(19, "price DIV 100", "extra_tax"),
        some(23, "price DIV 50", "loan"),
        some(13, "price DIV 10", "zone_rebate"),
        some(7, "price DIV 20", "untaxed"),
        some(5, "price DIV 30", "untaxed_other"),
        "earnings DIV 25 AS employer", "price DIV 200 AS health_extra", "price DIV 300 AS savings",
    )


def payroll_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payroll book as text under the official headers."""
    worker = f"concat({dotted('o_custkey % 80000000 + 10000000')}, '-', {check_char('o_custkey')})"
    columns = {
        payroll.COL_RUT: f"IF(o_custkey % 211 = 0, ' ', {worker})",
        payroll.COL_CONTRACT_END: "CASE WHEN o_orderkey % 17 = 0 THEN '31/12/2025' WHEN o_orderkey % 3 = 0 THEN 'NaT'"
        " WHEN o_orderkey % 2 = 0 THEN ' ' END",
        payroll.COL_WORKDAY: "CASE o_orderkey % 11 WHEN 0 THEN '701' WHEN 2 THEN 'abc' ELSE '101' END",
        payroll.COL_EARNINGS: f"IF(o_orderkey % 3 = 0, concat('$ ', {dotted('earnings')}, ',00'), string(earnings))",
        payroll.COL_EARNINGS_UNTAXED: "string(untaxed)",
        payroll.COL_EARNINGS_OTHER: "string(untaxed_other)",
        payroll.COL_PENSION: "'0'",
        payroll.COL_HEALTH: "'-'",
        payroll.COL_HEALTH_EXTRA: "string(health_extra)",
        payroll.COL_UNEMPLOYMENT: "'0'",
        payroll.COL_HEAVY_WORK: "''",
        payroll.COL_SAVINGS_B: "string(savings)",
        payroll.COL_TAX: "string(tax)",
        payroll.COL_TAX_SEVERANCE: "string(severance_tax)",
        payroll.COL_TAX_EXTRA: "string(extra_tax)",
        payroll.COL_TAX_BACKPAY: "string(backpay_tax)",
        payroll.COL_TAX_DIFFERENCE: "string(difference_tax)",
        payroll.COL_LOAN: "string(loan)",
        payroll.COL_ZONE_REBATE: "string(zone_rebate)",
        payroll.COL_CONTRIBUTIONS: "string(contributions)",
        payroll.COL_EMPLOYER: "string(employer)",
    }
    return payroll_numbers(spark, sf_dir).selectExpr(
        *[f"{sql} AS {name(header)}" for header, sql in columns.items()],
        "month AS MES_DJ",
        "concat('lre_', word, '_', o_orderkey % 3, '.csv') AS ARCHIVO_ORIGEN",
        "o_orderkey AS ord",
    )


BROKEN_CELL = "31/12/2025\nde mutuo acuerdo; \"art. 159\"\r\n\nfirmado"


def quoted_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payroll book whose contract ends, where given, have line breaks, separators and quotes."""
    end = name(payroll.COL_CONTRACT_END)
    return payroll_book(spark, sf_dir).withColumn(
        payroll.COL_CONTRACT_END, F.when(F.expr(f"{end} = '31/12/2025'"), F.lit(BROKEN_CELL)).otherwise(F.expr(end))
    )


def book_word() -> Column:
    """Name of a row's book without its ending."""
    return F.expr(f"concat('lre_', get(array{tuple(MONTH_WORDS)}, cast(array_position(array{MONTHS}, MES_DJ) AS INT) - 1))")


def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of payroll books in four files each, with the headers; some have two cells too many, some too few."""
    cells = ", ".join(f"coalesce({name(c)}, '')" for c in payroll.BOOK_COLUMNS)
    line = f"concat_ws(';', {cells})"
    rows = payroll_book(spark, sf_dir).withColumn("book", book_word()).selectExpr(
        "book", "ord % 4 AS part", "ord",
        f"CASE WHEN ord % 97 = 0 THEN concat({line}, ';9;9') WHEN ord % 89 = 0 THEN regexp_replace({line}, ';[^;]*$', '') ELSE {line} END AS value",
    )
    header = ";".join(payroll.BOOK_COLUMNS)
    headers = rows.groupBy("book", "part").agg(F.lit(-1).cast("bigint").alias("ord"), F.lit(header).alias("value"))
    return rows.unionByName(headers)
