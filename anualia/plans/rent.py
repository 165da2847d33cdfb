"""Return on rented real estate: validated, indexed, numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anualia.functions.amounts import clean_amount_plain, half_up_sql, whole_number
from anualia.functions.months import MONTHS, flag_sql
from anualia.functions.rut import normalize_rut, rut_is_valid, rut_order
from anualia.functions.template import name, select_computed, with_computed
from anualia.functions.text import CLEAN, clean_text, default_if_blank, strip
from anualia.operators.conform import (
    conform_columns,
    drop_blank_rows,
    is_numeric,
    number_text,
    require_columns,
)
from anualia.operators.quality import (
    ERROR,
    WARNING,
    Rule,
    ValidationError,
    Watch,
    gate,
    issue_table,
    require_rows,
    watch_rules,
)
from anualia.operators.sequence import number_rows
from anualia.operators.totals import summary_table, total
from anualia.params import INTERMEDIARY, TENANT, YearParameters, for_year

AMOUNT_COLUMNS = [f"Monto_{m}" for m in MONTHS]
INDEXED_COLUMNS = [f"Actualizado_{m}" for m in MONTHS]

# Columns of the rental sheet.
SHEET_COLUMNS = [
    "Rol_Parte_1", "Rol_Parte_2", "Codigo_Comuna", "Comuna", "Rut_Arrendador",
    "Rut_Arrendatario", *AMOUNT_COLUMNS, "Amoblado", "Destino_Arriendo", "DFL2",
    "Naturaleza_Bien_Raiz",
]
# Fixed value: message for an empty sheet.
NO_ROWS = "No existen bienes raíces cargados. Debes ingresar al menos un registro."
# Codes taken when a cell is blank.
DEFAULT_CODES = {"Amoblado": "1", "Destino_Arriendo": "2", "Naturaleza_Bien_Raiz": "2"}


def conform(sheet: DataFrame) -> DataFrame:
    """The fixed columns, cleaned and typed, plus the source position ``row_no``.

    ``sheet`` carries ``row_no``, the 1-based position of the row in its source;
    blank rows are dropped after they were counted. A column that is numeric
    already is taken as a number and never pushed through the text rules.
    """
    require_columns(sheet, ["row_no"])
    numeric = {c for c in SHEET_COLUMNS if c in sheet.columns and is_numeric(sheet, c)}
    texts = [c for c in SHEET_COLUMNS if c not in AMOUNT_COLUMNS]
    as_text = {c: number_text(sheet, c) for c in texts if c in numeric}
    df = drop_blank_rows(sheet, SHEET_COLUMNS).withColumns(as_text)
    df = conform_columns(df, SHEET_COLUMNS, keep=("row_no",))

    cleaned = {c: clean_text(name(c)) for c in texts}
    cleaned["Rut_Arrendador"] = normalize_rut(F.col("Rut_Arrendador"))
    cleaned["Rut_Arrendatario"] = normalize_rut(F.col("Rut_Arrendatario"))
    cleaned["DFL2"] = strip(F.upper(cleaned["DFL2"]))
    for c, default in DEFAULT_CODES.items():
        cleaned[c] = F.expr(default_if_blank(CLEAN.replace("{x}", c), default))
    for c in AMOUNT_COLUMNS:
        cleaned[c] = whole_number(c) if c in numeric else clean_amount_plain(c)
    return select_computed(df, ["row_no"], {c: cleaned[c] for c in SHEET_COLUMNS})


def index_amounts(
    conformed: DataFrame, params: YearParameters | None = None, apply_index: bool = True
) -> DataFrame:
    """Add restated months, their sum and the month flags.

    Every month is rounded before the sum. All of it is arithmetic over one row:
    no shuffle.
    """
    params = (params or for_year()).complete() if apply_index else params
    restated = [
        half_up_sql(f"Monto_{m} * {params.factor_milli[i]}L") if apply_index else f"Monto_{m}"
        for i, m in enumerate(MONTHS)
    ]
    indexed = conformed.select(
        "*", *[F.expr(f"{sql} AS Actualizado_{m}") for m, sql in zip(MONTHS, restated)]
    )
    flags = [F.expr(f"{flag_sql(f'Monto_{m} > 0')} AS {m}") for m in MONTHS]
    total_rent = F.expr(" + ".join(INDEXED_COLUMNS))
    return with_computed(indexed, "Monto_Arriendo", total_rent).select("*", *flags)


def base(
    sheet: DataFrame, params: YearParameters | None = None, apply_index: bool = True
) -> DataFrame:
    """Calculation base: conformed sheet with restated amounts."""
    return index_amounts(conform(sheet), params, apply_index)


def _checked(base_table: DataFrame, declarant_type: str) -> DataFrame:
    return base_table.withColumns({
        "_landlord_ok": rut_is_valid(F.col("Rut_Arrendador")),
        "_tenant_ok": rut_is_valid(F.col("Rut_Arrendatario")) if declarant_type == INTERMEDIARY else F.lit(True),
    })


def rules() -> list[Rule]:
    """What a row of the checked base must not be."""
    def codes(last: int) -> str:
        return ", ".join(f"'{i}'" for i in range(1, last + 1))

    # Wording of the messages.
    found = [
        (ERROR, "roll", "Rol_Parte_1 = '' OR Rol_Parte_2 = ''", "falta completar el Rol del Bien Raíz."),
        (ERROR, "commune_code", "Codigo_Comuna = ''", "falta código de comuna."),
        (ERROR, "commune_name", "Comuna = ''", "falta nombre de comuna."),
        (ERROR, "landlord_rut", "NOT _landlord_ok", "RUT arrendador inválido o incompleto."),
        (ERROR, "tenant_rut", "NOT _tenant_ok", "RUT arrendatario inválido o incompleto."),
        (ERROR, "amount", "Monto_Arriendo <= 0", "el monto anual de arriendo es cero."),
        (ERROR, "furnished", f"Amoblado NOT IN ({codes(2)})", "Amoblado debe ser 1 o 2."),
        (ERROR, "use", f"Destino_Arriendo NOT IN ({codes(6)})",
         "Destino del arriendo debe ser un código entre 1 y 6."),
        (ERROR, "nature", f"Naturaleza_Bien_Raiz NOT IN ({codes(2)})",
         "Naturaleza del bien raíz debe ser 1 o 2."),
        (WARNING, "no_month", " AND ".join(f"{c} <= 0" for c in AMOUNT_COLUMNS),
         "no tiene meses con monto informado."),
    ]
    return [(sev, rule, cond, f"concat('Fila ', row_no, ': {text}')") for sev, rule, cond, text in found]


def issues(base_table: DataFrame, declarant_type: str = TENANT) -> DataFrame:
    """All broken rules as a long table (row_no, severity, rule, message)."""
    return issue_table(_checked(base_table, declarant_type), ["row_no"], rules())


def watched(base_table: DataFrame, declarant_type: str = TENANT) -> tuple[DataFrame, Watch]:
    """The base, which counts its rows and broken rules while it is written, for :func:`check_watched`."""
    checked, watch = watch_rules(_checked(base_table, declarant_type), rules())
    return checked.drop("_landlord_ok", "_tenant_ok"), watch


def check_watched(watch: Watch, base_table: DataFrame, declarant_type: str = TENANT) -> None:
    """:func:`check` from what was counted; only a base with errors is read again, for its messages."""
    if not watch.rows():
        raise ValidationError(NO_ROWS)
    if watch.broken(ERROR):
        gate(issues(base_table, declarant_type))


def check(base_table: DataFrame, declarant_type: str = TENANT) -> None:
    """Stop if there is nothing to declare or any row breaks a rule."""
    require_rows(base_table, NO_ROWS)
    gate(issues(base_table, declarant_type))


def return_list(base_table: DataFrame, declarant_type: str = TENANT) -> DataFrame:
    """The numbered list: by landlord number, then the two roll parts as text."""
    reportable = base_table.filter(F.col("Monto_Arriendo") > 0)
    tenant = F.lit("") if declarant_type == TENANT else F.col("Rut_Arrendatario")
    listed = reportable.select(
        "row_no", "Rol_Parte_1", "Rol_Parte_2", "Codigo_Comuna", "Comuna", "Rut_Arrendador",
        tenant.alias("Rut_Arrendatario_DJ"), "Monto_Arriendo", *MONTHS,
        "Amoblado", "Destino_Arriendo", "DFL2", "Naturaleza_Bien_Raiz",
    )
    keys = [rut_order(F.col("Rut_Arrendador")), F.col("Rol_Parte_1"), F.col("Rol_Parte_2"), F.col("row_no")]
    return number_rows(listed, keys, "N°").drop("row_no")


def display_roll(df: DataFrame) -> DataFrame:
    """Add the roll as it is shown: both parts joined by a dash."""
    return df.withColumn("Rol", F.concat_ws("-", "Rol_Parte_1", "Rol_Parte_2"))


def summary(list_table: DataFrame) -> DataFrame:
    """Number of properties and total rent."""
    # Field names of the summary.
    return summary_table(list_table, [
        ("Total de casos informados", "count(*)"),
        ("Total de Monto Arriendo", total("Monto_Arriendo")),
    ])
