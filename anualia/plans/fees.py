"""Return on fees: withholding per payee, restated to year end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from anualia.functions.amounts import (
    coerce_integer,
    half_up,
    split_withholding,
)
from anualia.functions.months import (
    MONTHS,
    by_month,
    mask_flags,
    mask_months,
    month_bit,
    receipt_date,
)
from anualia.functions.rut import normalize_rut, rut_order_raw
from anualia.operators.quality import ERROR, WARNING, ValidationError, issue_table
from anualia.operators.sequence import sort_by
from anualia.operators.totals import summary_table, total
from anualia.params import YearParameters, for_year
from anualia.sources.parameters import with_parameters

# Column names of the receipts and of the reports.
NAME = "Nombre o Razón Social"
RECEIPT_COLUMNS = ["Fecha", "Estado", "Rut", NAME, "Brutos", "Retenido", "Pagado"]
AMOUNTS = ["Brutos", "Retenido", "Pagado"]
VALID = "VIGENTE"
FEE_HEADING = "Honorarios y Otros Art. 42 N°2 - Tasa 14,5%"
LOAN_HEADING = "3% Préstamo tasa 0% año 2021"

_SUMS = ["Brutos", "Retenido", "Retenido_Honorarios", "Retenido_Prestamo_3", "Pagado"]


def detail(receipts: DataFrame) -> DataFrame:
    """Valid receipts with a positive withholding, amounts and date typed.

    The status filter comes first, on the raw column, so that it reaches a
    columnar scan; columns other than those typed here pass through.
    """
    typed = receipts.filter(F.col("Estado") == VALID).withColumns(
        {c: coerce_integer(c) for c in AMOUNTS}
    )
    return (
        typed.filter(F.col("Retenido") > 0)
        .withColumn("Fecha", receipt_date(F.col("Fecha")))
        .withColumn("Mes", F.month("Fecha"))
    )


def split(lines: DataFrame, params: YearParameters | None = None) -> DataFrame:
    """Add base withholding, excess, loan share and fee share to every receipt."""
    params = params or for_year()
    parts = split_withholding(
        F.col("Brutos"), F.col("Retenido"), params.fee_rate_milli, params.loan_rate_milli
    )
    return (
        lines.withColumn("Retenido_Base_145", parts["base"])
        .withColumn("Exceso_Retencion", F.col("Retenido") - F.col("Retenido_Base_145"))
        .withColumn("Retenido_Prestamo_3", parts["loan"])
        .withColumn("Retenido_Honorarios", F.col("Retenido") - F.col("Retenido_Prestamo_3"))
    )


NO_DATE = "sin fecha"


def _month_name(month_no: str) -> str:
    """SQL text: code of the month, or the words for none."""
    return f"coalesce(get(array{MONTHS}, {month_no} - 1), '{NO_DATE}')"


def _factor(params: YearParameters) -> Column:
    """Factor of the receipt's month in thousandths; a month without one stops the job."""
    missing = F.raise_error(F.expr(f"concat('receipts without an index factor: ', {_month_name('Mes')})"))
    return F.coalesce(by_month(params.factor_milli, F.col("Mes")), missing.cast("bigint"))


def missing_months(lines: DataFrame, params: YearParameters | None = None) -> DataFrame:
    """Months of receipts that have no index factor, with the number of receipts."""
    params = params or for_year()
    bad = lines.where(by_month(params.factor_milli, F.col("Mes")).isNull())
    return bad.groupBy(F.expr(f"{_month_name('Mes')} AS month")).agg(F.count("*").alias("receipts"))


def watched(lines: DataFrame) -> tuple[DataFrame, Observation]:
    """The receipts, which note their months while they are written, for :func:`check_watched`."""
    seen = Observation()
    # Bits of the twelve months, and one more for receipts without a date.
    bit = F.coalesce(month_bit(F.col("Mes")), F.lit(1 << 12))
    return lines.observe(seen, F.coalesce(F.bit_or(bit), F.lit(0)).alias("months")), seen


def check_watched(seen: Observation, params: YearParameters | None = None) -> None:
    """Stop, naming the months, if receipts were noted in months without a factor."""
    params = params or for_year()
    names = [*zip(MONTHS, params.factor_milli), (NO_DATE, None)]
    mask = seen.get["months"]
    found = [name for i, (name, factor) in enumerate(names) if mask >> i & 1 and factor is None]
    if found:
        raise ValidationError("receipts in months without an index factor: " + ", ".join(found))


def annual(
    lines: DataFrame, params: YearParameters | None = None, normalize_keys: bool = False, by_year: DataFrame | None = None
) -> DataFrame:
    """One row per payee: sums, restated amounts, months and month flags.

    ``lines`` is the result of :func:`detail` with a BIGINT ``ord`` that gives the
    order of the receipts (it decides which spelling of a name wins). With a
    parameter table ``by_year`` (``sources.parameters``) every receipt takes the
    factor of its own year and month.

    Restated amounts are summed exactly and rounded once. The first grouping is
    by payee *and* name: all its buffers are fixed-width numbers, so it is a hash
    aggregate that combines on the map side, however hot one payee is. The
    second, which picks the name, sees about one row per payee.
    """
    params = params or for_year()
    if normalize_keys:
        lines = lines.withColumn("Rut", normalize_rut(F.col("Rut")))
    lines = split(lines.filter(F.col("Rut").isNotNull()), params)
    if by_year is None:
        lines = lines.withColumn("_f", _factor(params))
    else:
        missing = F.raise_error(F.expr("concat('receipts without an index factor: ', coalesce(date_format(Fecha, 'yyyy-MM'), 'sin fecha'))"))
        lines = with_parameters(lines, by_year, F.col("Fecha")).withColumn("_f", F.coalesce("factor_milli", missing.cast("bigint")))
    per_name = lines.groupBy("Rut", NAME).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.sum(F.col("Retenido_Honorarios") * F.col("_f")).alias("_fee"),
        F.sum(F.col("Retenido_Prestamo_3") * F.col("_f")).alias("_loan"),
        F.bit_or(month_bit(F.col("Mes"))).alias("_months"),
        F.min("ord").alias("_first"),
    )
    per_payee = per_name.groupBy("Rut").agg(
        F.min_by(NAME, "_first").alias(NAME),
        *[F.sum(c).alias(c) for c in _SUMS],
        half_up(F.sum("_fee"), 1000).alias("Honorarios_Actualizado"),
        half_up(F.sum("_loan"), 1000).alias("Prestamo_3_Actualizado"),
        F.bit_or("_months").alias("_months"),
    )
    reportable = per_payee.filter(
        (F.col("Retenido_Honorarios") > 0) | (F.col("Retenido_Prestamo_3") > 0)
    )
    return reportable.select(
        "Rut", NAME, "Brutos", "Retenido", "Retenido_Honorarios", "Retenido_Prestamo_3",
        "Honorarios_Actualizado", "Prestamo_3_Actualizado", "Pagado",
        mask_months("_months").alias("Meses"),
        *mask_flags("_months"),
    )


def sort_by_rut(df: DataFrame) -> DataFrame:
    """Order a list by RUT number; malformed ids come last."""
    return sort_by(df, [rut_order_raw(F.col("Rut")), F.col("Rut")])


def return_list(annual_table: DataFrame, numbered_headings: bool = True) -> DataFrame:
    """The list to declare, sorted by RUT number."""
    fee, loan = (
        (FEE_HEADING, LOAN_HEADING)
        if numbered_headings
        else ("Honorarios_Actualizado", "Prestamo_3_Actualizado")
    )
    return sort_by_rut(annual_table).select(
        "Rut", NAME, F.col("Honorarios_Actualizado").alias(fee), *MONTHS,
        F.col("Prestamo_3_Actualizado").alias(loan),
    )


def summary(annual_table: DataFrame) -> DataFrame:
    """Totals of the return; the annual table has one row per payee."""
    zero = "0"
    # Field names of the summary, in report order.
    return summary_table(annual_table, [
        (FEE_HEADING, total("Honorarios_Actualizado")),
        ("Remuneración Directores Art. 48 - Tasa 10%", zero),
        ("Remuneración Directores Art. 48 - Tasa 35%", zero),
        ("Monto pagado anual actualizado por servicios en Isla de Pascua", zero),
        (LOAN_HEADING, total("Prestamo_3_Actualizado")),
        ("Monto total honorarios sin actualizar", total("Brutos")),
        ("Total casos informados", "count(Rut)"),
    ])


def missing_factor_issues(lines: DataFrame) -> DataFrame:
    """Receipts without a usable date, hence without an index factor."""
    return issue_table(lines, ["Rut"], [
        (ERROR, "no_factor", "Mes IS NULL", "'receipt has no month, so no index factor'"),
    ])


def other_year_issues(lines: DataFrame, commercial_year: int) -> DataFrame:
    """Receipts dated in another year; they stay in the return but deserve a look."""
    return issue_table(lines, ["Rut"], [
        (WARNING, "other_year", f"year(Fecha) <> {commercial_year}", "concat('receipt dated in ', year(Fecha))"),
    ])


def rut_issues(annual_table: DataFrame) -> DataFrame:
    """Payees whose RUT cannot be put in order."""
    ordered = annual_table.withColumn("_order", rut_order_raw(F.col("Rut")))
    return issue_table(ordered, ["Rut"], [
        (WARNING, "malformed_rut", "_order IS NULL", "concat('RUT has no number: ', Rut)"),
    ])
