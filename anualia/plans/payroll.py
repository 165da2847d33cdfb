"""Return on payroll: worker-month base, one line per worker, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anualia.functions.amounts import NUMBER, clean_amount_locale, half_up_sql, rounded_number
from anualia.functions.months import MONTHS, by_month, month_number
from anualia.functions.rut import normalize_rut, rut_order
from anualia.functions.tax import tax_inverse, utm_sql
from anualia.functions.template import name, quote
from anualia.functions.text import clean_text
from anualia.operators.conform import is_numeric, quoted, require_columns
from anualia.operators.quality import WARNING, issue_table
from anualia.operators.sequence import number_rows
from anualia.operators.totals import summary_table, total
from anualia.params import YearParameters, for_year

# Headers of the payroll book.
COL_RUT = "Rut trabajador(1101)"
COL_CONTRACT_END = "Fecha término de contrato(1103)"
COL_WORKDAY = "Código tipo de jornada(1107)"
COL_EARNINGS = "Total haberes imponibles y tributables(5210)"
COL_EARNINGS_UNTAXED = "Total haberes imponibles no tributables(5220)"
COL_EARNINGS_OTHER = "Total haberes no imponibles y no tributables(5230)"
COL_PENSION = "Cotización obligatoria previsional (AFP o IPS)(3141)"
COL_HEALTH = "Cotización obligatoria salud 7%(3143)"
COL_HEALTH_EXTRA = "Cotización voluntaria para salud(3144)"
COL_UNEMPLOYMENT = "Cotización AFC - trabajador(3151)"
COL_HEAVY_WORK = "Cotización adicional trabajo pesado - trabajador(3154)"
COL_SAVINGS_B = "Cotización APVi Mod B hasta UF50(3156)"
COL_TAX = "Impuesto retenido por remuneraciones(3161)"
COL_TAX_SEVERANCE = "Impuesto retenido por indemnizaciones(3162)"
COL_TAX_EXTRA = "Mayor retención de impuestos solicitada por el trabajador(3163)"
COL_TAX_BACKPAY = "Impuesto retenido por reliquidación remun. devengadas otros períodos(3164)"
COL_TAX_DIFFERENCE = "Diferencia impuesto reliquidación remun. devengadas en este período(3165)"
COL_LOAN = "Retención préstamo clase media 2020 (Ley 21.252) (3166)"
COL_ZONE_REBATE = "Rebaja zona extrema DL 889 (3167)"
COL_CONTRIBUTIONS = "Total descuentos por cotizaciones del trabajador(5341)"
COL_EMPLOYER = "Total aportes empleador(5410)"

REQUIRED_COLUMNS = [COL_RUT, COL_EARNINGS, COL_TAX]
BOOK_COLUMNS = [
    COL_RUT, COL_CONTRACT_END, COL_WORKDAY, COL_EARNINGS, COL_EARNINGS_UNTAXED, COL_EARNINGS_OTHER,
    COL_PENSION, COL_HEALTH, COL_HEALTH_EXTRA, COL_UNEMPLOYMENT, COL_HEAVY_WORK, COL_SAVINGS_B,
    COL_TAX, COL_TAX_SEVERANCE, COL_TAX_EXTRA, COL_TAX_BACKPAY, COL_TAX_DIFFERENCE, COL_LOAN,
    COL_ZONE_REBATE, COL_CONTRIBUTIONS, COL_EMPLOYER,
]

# Internal name of every amount column of the book.
AMOUNTS = {
    "Total_Haberes_Imp_Trib": COL_EARNINGS,
    "Haberes_Imp_No_Trib": COL_EARNINGS_UNTAXED,
    "Haberes_No_Imp_No_Trib": COL_EARNINGS_OTHER,
    "Cot_AFP": COL_PENSION,
    "Cot_Salud": COL_HEALTH,
    "Cot_Salud_Voluntaria": COL_HEALTH_EXTRA,
    "Cot_AFC_Trab": COL_UNEMPLOYMENT,
    "Cot_Trabajo_Pesado_Trab": COL_HEAVY_WORK,
    "APVI_Mod_B": COL_SAVINGS_B,
    "IUSC": COL_TAX,
    "IUSC_Indemnizaciones": COL_TAX_SEVERANCE,
    "IUSC_Reliquidacion": COL_TAX_BACKPAY,
    "Diferencia_Reliquidacion": COL_TAX_DIFFERENCE,
    "Mayor_Retencion": COL_TAX_EXTRA,
    "Prestamo_3": COL_LOAN,
    "Rebaja_Zona_Extrema": COL_ZONE_REBATE,
    "Total_Cotizaciones_Trabajador": COL_CONTRIBUTIONS,
    "Total_Aportes_Empleador": COL_EMPLOYER,
}

# Texts and codes of the result.
INFERRED, FALLBACK = "Inferida desde IUSC", "Fallback LRE"
NO_END_TEXTS = ("", "nan", "NaT", "None")
PARTIAL_HOURS, FULL_HOURS, PARTIAL_FROM_CODE = 99, 40, 700

# Amounts restated to year end and the names of the results.
RESTATED = {
    "Renta_Total_Neta_Actualizada": "Renta_Total_Neta_Mensual",
    "IUSC_Actualizado": "IUSC_Total_Mensual",
    "Mayor_Retencion_Actualizada": "Mayor_Retencion",
    "Renta_No_Gravada_Actualizada": "Renta_No_Gravada_Mensual",
    "Rebaja_Zona_Extrema_Actualizada": "Rebaja_Zona_Extrema",
    "Prestamo_3_Actualizado": "Prestamo_3",
    "Remuneracion_Imponible_Prev_Actualizada": "Total_Haberes_Imp_Trib",
}

# Columns summed per worker and month, in output order.
MONTH_SUMS = [
    "Renta_Total_Neta_Mensual", "Renta_Inferida_IUSC", "Renta_LRE_Fallback",
    "Monto_Ingreso_Mensual_Sin_Actualizar", "IUSC", "IUSC_Indemnizaciones", "IUSC_Total_Mensual",
    "Mayor_Retencion", "Renta_No_Gravada_Mensual", "Renta_Exenta_Mensual", "Rebaja_Zona_Extrema",
    "Prestamo_3", "Leyes_Sociales", "Total_Haberes_Imp_Trib", "Cotizaciones_Deducibles_Renta_Neta",
    "Cot_Salud_Voluntaria", "APVI_Mod_B", "Renta_Total_Neta_Actualizada", "IUSC_Actualizado",
    "Mayor_Retencion_Actualizada", "Renta_No_Gravada_Actualizada", "Renta_Exenta_Actualizada",
    "Rebaja_Zona_Extrema_Actualizada", "Prestamo_3_Actualizado",
    "Remuneracion_Imponible_Prev_Actualizada",
]

# Columns summed per worker, as they appear around the months.
LIST_HEAD = [
    "Renta_Total_Neta_Actualizada", "IUSC_Actualizado", "Mayor_Retencion_Actualizada",
    "Renta_No_Gravada_Actualizada", "Renta_Exenta_Actualizada", "Rebaja_Zona_Extrema_Actualizada",
    "Prestamo_3_Actualizado",
]
LIST_TAIL = [
    "Renta_Total_Neta_Mensual", "IUSC_Total_Mensual", "Renta_No_Gravada_Mensual",
    "Renta_Exenta_Mensual", "Rebaja_Zona_Extrema", "Prestamo_3", "Leyes_Sociales",
    "Remuneracion_Imponible_Prev_Actualizada",
]


def amount(book: DataFrame, header: str) -> Column:
    """Amount column of the book; 0 on every row if the book lacks it."""
    if header not in book.columns:
        return F.expr("0L")
    return (rounded_number if is_numeric(book, header) else clean_amount_locale)(name(header))


def contract_ended(book: DataFrame) -> Column:
    """Does the row carry a contract end?"""
    if COL_CONTRACT_END not in book.columns:
        return F.lit(False)
    return ~clean_text(name(COL_CONTRACT_END)).isin(*NO_END_TEXTS)


def weekly_hours(book: DataFrame) -> Column:
    """Weekly-hours code from the kind of workday; an unreadable code counts as 0."""
    if COL_WORKDAY not in book.columns:
        return F.lit(FULL_HOURS)
    code = name(COL_WORKDAY)
    number = f"CASE WHEN string({code}) RLIKE {quote(NUMBER)} THEN cast({code} AS DOUBLE) END"
    return F.expr(f"IF({number} >= {PARTIAL_FROM_CODE}, {PARTIAL_HOURS}, {FULL_HOURS})")


def amounts(book: DataFrame) -> DataFrame:
    """Rows of the book under internal names: keys, 18 amounts, hours and end mark.

    Amounts nobody reads further down are pruned by the optimizer, down to the scan.
    """
    require_columns(book, REQUIRED_COLUMNS)
    return book.select(
        normalize_rut(quoted(COL_RUT)).alias("Rut_Trabajador"),
        "MES_DJ",
        "ARCHIVO_ORIGEN",
        "ord",
        *[amount(book, header).alias(internal) for internal, header in AMOUNTS.items()],
        contract_ended(book).alias("Tiene_Termino"),
        weekly_hours(book).alias("Horas_Semanales"),
    )


def lines(book: DataFrame, params: YearParameters | None = None) -> DataFrame:
    """Every row of the book with its computed amounts; one narrow stage, no shuffle.

    ``book`` has text columns under the official headers, plus ``MES_DJ``,
    ``ARCHIVO_ORIGEN`` and the numeric row order ``ord``.
    """
    params = (params or for_year()).complete()
    df = amounts(book).withColumn("_month_no", month_number(F.col("MES_DJ")))
    df = df.selectExpr(
        "*",
        f"{utm_sql('_month_no', params)} AS _utm",
        "Total_Cotizaciones_Trabajador AS Cotizaciones_Deducibles_Renta_Neta",
        "greatest(Total_Haberes_Imp_Trib - Total_Cotizaciones_Trabajador, 0L) AS Renta_LRE_Fallback",
        "IUSC + IUSC_Indemnizaciones + IUSC_Reliquidacion + Diferencia_Reliquidacion AS IUSC_Total_Mensual",
        "Haberes_Imp_No_Trib + Haberes_No_Imp_No_Trib AS Renta_No_Gravada_Mensual",
        "Total_Cotizaciones_Trabajador + Total_Aportes_Empleador AS Leyes_Sociales",
        "0L AS Renta_Exenta_Mensual",
        "0L AS Renta_Exenta_Actualizada",
    )
    df = df.withColumns({
        "Renta_Inferida_IUSC": tax_inverse("IUSC_Total_Mensual", "_utm", params),
        "_factor": by_month(params.factor_milli, F.col("_month_no")),
    })
    df = df.selectExpr(
        "*",
        "IF(IUSC_Indemnizaciones > 0, Renta_LRE_Fallback, coalesce(Renta_Inferida_IUSC, Renta_LRE_Fallback))"
        " AS Renta_Total_Neta_Mensual",
        f"IF(Renta_Inferida_IUSC IS NOT NULL, '{INFERRED}', '{FALLBACK}') AS Metodo_Renta",
    )
    df = df.selectExpr(
        "*", "Renta_Total_Neta_Mensual + Rebaja_Zona_Extrema AS Monto_Ingreso_Mensual_Sin_Actualizar"
    )
    return df.selectExpr(
        "*",
        *[f"{half_up_sql(f'{source} * _factor')} AS {restated}" for restated, source in RESTATED.items()],
        "CASE WHEN Tiene_Termino THEN 'F' WHEN Monto_Ingreso_Mensual_Sin_Actualizar > 0 THEN 'C' ELSE '' END"
        " AS Periodo_DJ",
    ).drop("_month_no", "_factor", "_utm")


_WORD = 63  # files in one BIGINT
MOST_WORDS = 64  # so many words are buffers of the aggregate; more files are gathered as texts
# Names of the files in one word, in order; a word without any is null and costs nothing.
_NAMED = """CASE WHEN {word} <> 0 THEN array_join(transform(
    filter(sequence(0, {last}), i -> getbit({word}, i) = 1), i -> get(array({names}), i)), ' | ') END"""


def _numbered(df: DataFrame, names: list[str]) -> DataFrame:
    """Add the number of the source file in the sorted list; a file that is not in it raises."""
    spark = df.sparkSession
    numbers = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "ARCHIVO_ORIGEN string, _file int")
    unknown = F.raise_error(F.concat(F.lit("file not in the given list: "), "ARCHIVO_ORIGEN")).cast("int")
    # At most MOST_WORDS * 63 names.
    joined = df.join(F.broadcast(numbers), "ARCHIVO_ORIGEN", "left")
    return joined.withColumn("_file", F.when(F.col("ARCHIVO_ORIGEN").isNotNull(), F.coalesce("_file", unknown)))


def _file_masks(names: list[str]) -> tuple[list[Column], Column]:
    """Aggregates and final text for a set of numbered files: one BIGINT for each 63 of them, all fixed-width."""
    words = range(-(-len(names) // _WORD))
    masks = [
        F.expr(f"coalesce(bit_or(CASE WHEN _file DIV {_WORD} = {w} THEN shiftleft(1L, _file % {_WORD}) END), 0L) AS _files{w}") for w in words
    ]
    texts = []
    for w in words:
        known = names[w * _WORD : (w + 1) * _WORD]
        texts.append(_NAMED.replace("{word}", f"_files{w}").replace("{last}", str(len(known) - 1)).replace("{names}", ", ".join(quote(n) for n in known)))
    return masks, F.expr(f"concat_ws(' | ', {', '.join(texts)})")


def _file_texts(df: DataFrame, keys: list[str]) -> DataFrame:
    """The set of files of each key as text, for any number of files: distinct rows first, by hash."""
    per_file = df.select(*keys, "ARCHIVO_ORIGEN").distinct().groupBy(*keys)
    return per_file.agg(F.array_join(F.array_sort(F.collect_list("ARCHIVO_ORIGEN")), " | ").alias("ARCHIVO_ORIGEN"))


def file_names(df: DataFrame, files: Sequence[str] | None = None) -> list[str] | None:
    """Sorted names of the source files, or none if there are too many for masks."""
    most = _WORD * MOST_WORDS
    if files is None:
        found = df.select("ARCHIVO_ORIGEN").where("ARCHIVO_ORIGEN IS NOT NULL").distinct().limit(most + 1).collect()
        files = [r[0] for r in found]
    names = sorted(set(files))
    return names if len(names) <= most else None


def worker_month(
    book: DataFrame, params: YearParameters | None = None, files: Sequence[str] | None = None
) -> DataFrame:
    """One row per worker and month.

    The first non-empty period is found with two minima over ``ord`` and the
    method labels with two booleans, so all buffers are fixed-width: this is one
    hash aggregate with map-side combine and one shuffle, and a worker with very
    many rows costs no more than any other. The set of source files is kept in bit
    masks over the numbered names; without ``files`` the names are looked up first.
    Some four thousand files and more are gathered apart and joined.
    """
    df = lines(book, params)
    keys = ["Rut_Trabajador", "MES_DJ"]
    names = file_names(book, files)
    masks, file_text = _file_masks(names) if names else ([], F.lit(""))
    per_file = _numbered(df, names) if names else df
    grouped = per_file.groupBy(*keys).agg(
        *[F.expr(f"coalesce(sum({c}), 0L) AS {c}") for c in MONTH_SUMS],
        F.expr("min(CASE WHEN Periodo_DJ = 'F' THEN ord END) AS _first_f"),
        F.expr("min(CASE WHEN Periodo_DJ = 'C' THEN ord END) AS _first_c"),
        F.max("Horas_Semanales").alias("Horas_Semanales"),
        F.expr(f"bool_or(Metodo_Renta = '{FALLBACK}') AS _fallback"),
        F.expr(f"bool_or(Metodo_Renta = '{INFERRED}') AS _inferred"),
        *masks,
    )
    if names is None:
        texts = _file_texts(df, keys).withColumnsRenamed({k: f"_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        grouped, file_text = grouped.join(texts, same, "left"), F.col("ARCHIVO_ORIGEN")
    return grouped.select(
        "Rut_Trabajador", "MES_DJ", *MONTH_SUMS,
        F.expr(
            "CASE WHEN _first_f IS NOT NULL AND (_first_c IS NULL OR _first_f < _first_c) THEN 'F'"
            " WHEN _first_c IS NOT NULL THEN 'C' ELSE '' END AS Periodo_DJ"
        ),
        "Horas_Semanales",
        file_text.alias("ARCHIVO_ORIGEN"),
        F.expr(
            f"concat_ws(' / ', CASE WHEN _fallback THEN '{FALLBACK}' END,"
            f" CASE WHEN _inferred THEN '{INFERRED}' END) AS Metodo_Renta"
        ),
    )


def period_pivot() -> list[Column]:
    """Aggregates for one period column per month, as a small code.

    A worker has one row per month, so the maximum is that row's own code.
    """
    code = "CASE Periodo_DJ WHEN 'F' THEN 2 WHEN 'C' THEN 1 END"
    return [F.expr(f"max(CASE WHEN MES_DJ = '{m}' THEN {code} END) AS {m}") for m in MONTHS]


def period_texts() -> dict[str, Column]:
    """The month columns of the period pivot as texts."""
    return {m: F.expr(f"CASE {m} WHEN 2 THEN 'F' WHEN 1 THEN 'C' ELSE '' END") for m in MONTHS}


def income_pivot() -> list[Column]:
    """Aggregates for one income column per month; a month without rows is 0."""
    income = "Monto_Ingreso_Mensual_Sin_Actualizar"
    return [
        F.expr(f"coalesce(sum(CASE WHEN MES_DJ = '{m}' THEN {income} END), 0L) AS Ingreso_{m}") for m in MONTHS
    ]


def consolidate(months: DataFrame) -> DataFrame:
    """One row per worker: sums, longest hours code and both pivots in one aggregate."""
    per_worker = months.groupBy("Rut_Trabajador").agg(
        *[F.expr(f"sum({c}) AS {c}") for c in dict.fromkeys(LIST_HEAD + LIST_TAIL)],
        F.max("Horas_Semanales").alias("Horas_Semanales"),
        *period_pivot(),
        *income_pivot(),
    )
    return per_worker.withColumns(period_texts())


def return_list(months: DataFrame, status_text: str = "Calculada") -> DataFrame:
    """The numbered list of workers, by RUT number."""
    listed = consolidate(months)
    keys = [rut_order(F.col("Rut_Trabajador")), F.col("Rut_Trabajador")]
    numbered = number_rows(listed, keys, "N°")
    return numbered.select(
        "N°", "Rut_Trabajador", *LIST_HEAD, *MONTHS, F.col("N°").alias("Número Certificado"),
        *[f"Ingreso_{m}" for m in MONTHS], "Horas_Semanales",
        F.lit(status_text).alias("ESTADO"), *LIST_TAIL,
    )


def summary(list_table: DataFrame) -> DataFrame:
    """The 28 totals of the return."""
    # Field names of the summary, in report order.
    fields = {
        "Renta Total Neta Pagada Actualizada": "Renta_Total_Neta_Actualizada",
        "Impuesto Único Retenido Actualizado": "IUSC_Actualizado",
        "Mayor Retención Solicitada Actualizada": "Mayor_Retencion_Actualizada",
        "Renta Total No Gravada Actualizada": "Renta_No_Gravada_Actualizada",
        "Renta Total Exenta Actualizada": "Renta_Exenta_Actualizada",
        "Rebaja Zonas Extremas Actualizada": "Rebaja_Zona_Extrema_Actualizada",
        "3% Préstamo Tasa 0% Actualizado": "Prestamo_3_Actualizado",
        "Renta Total Neta Pagada Sin Actualizar": "Renta_Total_Neta_Mensual",
        "IUSC Retenido Sin Actualizar": "IUSC_Total_Mensual",
        "Renta No Gravada Sin Actualizar": "Renta_No_Gravada_Mensual",
        "Renta Exenta Sin Actualizar": "Renta_Exenta_Mensual",
        "Rebaja Zona Extrema Sin Actualizar": "Rebaja_Zona_Extrema",
        "Leyes Sociales": "Leyes_Sociales",
        "3% Préstamo Sin Actualizar": "Prestamo_3",
        "Remuneración Imponible Previsional Actualizada": "Remuneracion_Imponible_Prev_Actualizada",
    }
    return summary_table(list_table, [
        ("Total Casos Informados", "count(*)"),
        *[(label, total(column)) for label, column in fields.items()],
        *[(f"Ingreso Mensual {m} Sin Actualizar", total(f"Ingreso_{m}")) for m in MONTHS],
    ])


def blank_worker_issues(months: DataFrame) -> DataFrame:
    """Workers without a RUT; they stay in the return under an empty id."""
    return issue_table(months, ["MES_DJ"], [
        (WARNING, "blank_rut", "Rut_Trabajador = ''", "'rows without a worker RUT'"),
    ])
