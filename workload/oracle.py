"""The expected result of every query, stated in DuckDB SQL over the same tables.

The SQL works on the numbers behind the texts that the Spark side parses, and
with decimals where the Spark side uses scaled integers, so that both sides can
only agree by being right.
"""

from __future__ import annotations

from anualia.params import BRACKETS_2025, FACTORS_2025, MONTHS, UTM_2025
from workload.adapters import MONTH_WORDS

# Headers of two compulsory columns of a payroll book.
_WORKER, _TAX = "Rut trabajador(1101)", "Impuesto retenido por remuneraciones(3161)"
_PARAMS = ", ".join(
    f"({i + 1}, '{m}', '{MONTH_WORDS[i]}', {FACTORS_2025[m]}::DECIMAL(4,3), {UTM_2025[m]}::BIGINT)"
    for i, m in enumerate(MONTHS)
)
_BRACKETS = ", ".join(
    f"({lo}::DECIMAL(6,2), {hi or 'NULL'}::DECIMAL(6,2), {f}::DECIMAL(6,3), {r}::DECIMAL(6,2))"
    for lo, hi, f, r in BRACKETS_2025
)
_PARAM_CTE = f"""
p(month_no, month, word, factor, utm) AS (VALUES {_PARAMS}),
br(lo, hi, f, r) AS (VALUES {_BRACKETS})"""


def _char(key: str) -> str:
    return f"substr('0123456789K', ({key} % 11 + 1)::INT, 1)"


def _rut(key: str, span: int, start: int) -> str:
    return f"(({key} % {span} + {start})::VARCHAR || '-' || {_char(key)})"


def _dots(value: str) -> str:
    return f"replace(format('{{:,}}', {value}), ',', '.')"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'X' ELSE '' END"


def _rows(source: str, fields: list[tuple[str, str]]) -> str:
    """Key-value table of aggregates over one source."""
    return " UNION ALL ".join(
        f"SELECT '{label}' AS \"Campo\", ({expr})::BIGINT AS \"Monto\" FROM {source}" for label, expr in fields
    )


# ---- fees --------------------------------------------------------------------

_FEES_CTE = f"""
{_PARAM_CTE},
src AS (
  SELECT o_orderkey AS ord, o_orderdate::DATE AS d, month(o_orderdate) AS m, o_orderstatus AS st,
         floor(o_totalprice)::BIGINT AS b, {_rut('o_custkey', 80_000_000, 10_000_000)} AS rut,
         CASE WHEN month(o_orderdate) % 2 = 0 THEN upper(c_name) ELSE c_name END AS name
  FROM orders JOIN customer ON o_custkey = c_custkey),
held AS (
  SELECT *, CASE WHEN ord % 4 = 0 THEN 0 WHEN ord % 4 = 1 THEN round(b * 0.145)::BIGINT
            ELSE round(b * 0.145)::BIGINT + trunc(b * 0.03)::BIGINT END AS w FROM src),
det AS (SELECT * FROM held WHERE st = 'O' AND w > 0),
spl AS (
  SELECT *, round(b * 0.145)::BIGINT AS base,
         CASE WHEN w > round(b * 0.145) THEN trunc(b * 0.03)::BIGINT ELSE 0 END AS loan FROM det),
ann AS (
  SELECT rut, arg_min(name, ord) AS name, sum(b)::BIGINT AS b, sum(w)::BIGINT AS w,
         sum(w - loan)::BIGINT AS fee, sum(loan)::BIGINT AS loan, sum(b - w)::BIGINT AS paid,
         round(sum((w - loan) * factor))::BIGINT AS fee_up, round(sum(loan * factor))::BIGINT AS loan_up,
         list_sort(list(DISTINCT m)) AS months
  FROM spl JOIN p ON m = month_no GROUP BY rut
  HAVING sum(w - loan) > 0 OR sum(loan) > 0)"""

_ANN_FLAGS = ", ".join(f"{_flag(f'list_contains(months, {i + 1})')} AS \"{m}\"" for i, m in enumerate(MONTHS))
_ANNUAL = f"""
SELECT rut AS "Rut", name AS "Nombre", b AS "Brutos", w AS "Retenido", fee AS "Retenido_Honorarios",
       loan AS "Retenido_Prestamo_3", fee_up AS "Honorarios_Actualizado", loan_up AS "Prestamo_3_Actualizado",
       paid AS "Pagado", array_to_string(months, ',') AS "Meses", {_ANN_FLAGS} FROM ann"""
_DETAIL = """
SELECT d AS "Fecha", 'VIGENTE' AS "Estado", rut AS "Rut", name AS "Nombre", b AS "Brutos", w AS "Retenido",
       (b - w)::BIGINT AS "Pagado", m::INT AS "Mes" """

_BAD_PAGE = "ord % 77 = 0 OR ord % 50 = 0"


def _fee_summary() -> str:
    return _rows("ann", [
        ("Honorarios y Otros Art. 42 N°2 - Tasa 14,5%", "coalesce(sum(fee_up), 0)"),
        ("Remuneración Directores Art. 48 - Tasa 10%", "max(0)"),
        ("Remuneración Directores Art. 48 - Tasa 35%", "max(0)"),
        ("Monto pagado anual actualizado por servicios en Isla de Pascua", "max(0)"),
        ("3% Préstamo tasa 0% año 2021", "coalesce(sum(loan_up), 0)"),
        ("Monto total honorarios sin actualizar", "coalesce(sum(b), 0)"),
        ("Total casos informados", "count(DISTINCT rut)"),
    ])


def _fee_sql() -> dict[str, str]:
    w = f"WITH {_FEES_CTE} "
    company = "replace(upper(name), '#', ' ')"
    return {
        "status_and_withholding_filter": w + _DETAIL + """, 'm' || m::VARCHAR AS "Archivo_Origen", ord FROM det""",
        "fee_report_scan": w + _DETAIL + f""", 'r' || ord::VARCHAR AS "Archivo_Origen",
            {company} AS "Nombre_Empresa_Declarante", rut AS "Rut_Empresa_Declarante"
            FROM det WHERE NOT ({_BAD_PAGE})""",
        "fee_report_spans": w + _DETAIL + f""", 'r' || ord::VARCHAR AS "Archivo_Origen",
            {company} AS "Nombre_Empresa_Declarante", rut AS "Rut_Empresa_Declarante"
            FROM (SELECT d, rut, name, b + k AS b, w, m, ord FROM det, (VALUES (0), (1)) AS twice(k))""",
        "fee_report_nested": w + _DETAIL + f""", 'r' || ord::VARCHAR AS "Archivo_Origen",
            {company} AS "Nombre_Empresa_Declarante", rut AS "Rut_Empresa_Declarante" FROM det""",
        "fee_report_rejects": w + f"""SELECT 'r' || ord::VARCHAR AS file,
            CASE WHEN ord % 77 = 0 THEN 'no table found' ELSE 'not exactly one column Estado' END AS reason
            FROM src WHERE {_BAD_PAGE}""",
        "withholding_split": w + """SELECT ord, b AS "Brutos", w AS "Retenido", base AS "Retenido_Base_145",
            (w - base)::BIGINT AS "Exceso_Retencion", loan::BIGINT AS "Retenido_Prestamo_3",
            (w - loan)::BIGINT AS "Retenido_Honorarios" FROM spl""",
        "fee_sum_then_round": w + """SELECT rut AS "Rut", fee_up AS "Honorarios_Actualizado",
            loan_up AS "Prestamo_3_Actualizado" FROM ann""",
        "fee_annual": w + _ANNUAL,
        "report_bundle": w + """SELECT rut AS "Rut", name AS "Nombre", b AS "Brutos",
            fee_up AS "Honorarios_Actualizado", array_to_string(months, ',') AS "Meses" FROM ann""",
        "report_bundle_manifest": w + """SELECT 'Resumen_Anual' AS sheet, rut AS key, b AS amount FROM ann
            UNION ALL SELECT 'Detalle_Boletas', rut, w FROM det
            UNION ALL SELECT 'Cuadro_Resumen', "Campo", "Monto" FROM (""" + _fee_summary() + ")",
        "receipt_tax_year": w + """SELECT (year(d) + 1)::INT AS tax_year, count(*) AS receipts, sum(w)::BIGINT AS withheld
            FROM det GROUP BY 1""",
        "fee_missing_months": w + """SELECT CASE WHEN ord % 10 = 0 THEN 'sin fecha' ELSE month END AS month, count(*) AS receipts
            FROM det JOIN p ON m = month_no WHERE ord % 10 = 0 OR m > 10 GROUP BY 1""",
        "parameter_join_years": w + """SELECT ord, year(d)::INT AS commercial_year, m::INT AS month_no,
            CASE WHEN year(d) = 1996 THEN utm - 9000 WHEN year(d) = 1997 AND m <= 10 THEN utm - 4000 END AS utm,
            CASE WHEN year(d) = 1996 THEN round(w * (factor + 0.010)) WHEN year(d) = 1997 AND m <= 10 THEN round(w * (factor + 0.005)) END::BIGINT AS restated
            FROM det JOIN p ON m = month_no""",
        "parameter_unknown_months": w + """SELECT year(d)::INT AS commercial_year, m::INT AS month_no, count(*) AS rows
            FROM det WHERE NOT (year(d) = 1996 OR year(d) = 1997 AND m <= 10) GROUP BY 1, 2""",
        "fee_return": w + f"""SELECT rut AS "Rut", name AS "Nombre", fee_up AS "Honorarios_Actualizado",
            {_ANN_FLAGS}, loan_up AS "Prestamo_3_Actualizado" FROM ann
            ORDER BY split_part(rut, '-', 1)::BIGINT, rut""",
        "fee_summary": w + _fee_summary(),
        "fee_other_year": w + """SELECT rut AS "Rut", 'W' AS severity, 'other_year' AS rule,
            'receipt dated in ' || year(d)::VARCHAR AS message FROM det WHERE year(d) <> 1997""",
        "fee_missing_factor": w + """SELECT rut AS "Rut", 'E' AS severity, 'no_factor' AS rule,
            'receipt has no month, so no index factor' AS message FROM det WHERE ord % 10 = 0""",
        "range_sequence_number": w + """SELECT row_number() OVER (
            ORDER BY split_part(rut, '-', 1)::BIGINT, rut, ord) AS n, rut AS "Rut", ord FROM src""",
    }


# ---- rent --------------------------------------------------------------------

_MONTH_SUMS = ", ".join(
    f"CASE WHEN l_partkey % 137 = 0 THEN 0 ELSE coalesce(sum(floor(l_extendedprice)::BIGINT) "
    f"FILTER (month(l_shipdate) = {i + 1}), 0) END::BIGINT AS r{i + 1}"
    for i in range(12)
)
_UPS = ", ".join(f"round(r{i + 1} * {FACTORS_2025[m]})::BIGINT AS u{i + 1}" for i, m in enumerate(MONTHS))
_U_SUM = " + ".join(f"u{i + 1}" for i in range(12))
_R_SUM = " + ".join(f"r{i + 1}" for i in range(12))
_RENT_CTE = f"""
props AS (
  SELECT l_suppkey AS s, l_partkey AS k, {_MONTH_SUMS} FROM lineitem GROUP BY l_suppkey, l_partkey),
base AS (
  SELECT *, k * 10000000 + s AS row_no,
    CASE WHEN k % 101 = 0 THEN '' ELSE (k % 97)::VARCHAR END AS roll1, k::VARCHAR AS roll2,
    CASE WHEN k % 103 = 0 THEN '' ELSE (n_nationkey + 13100)::VARCHAR END AS code,
    CASE WHEN k % 107 = 0 THEN '' ELSE n_name END AS commune,
    CASE WHEN k % 109 = 0 THEN 'SINRUT' ELSE {_rut('s', 80_000_000, 10_000_000)} END AS landlord,
    CASE WHEN k % 109 = 0 THEN 0 ELSE s % 80000000 + 10000000 END AS landlord_no,
    CASE WHEN k % 4 = 0 THEN '' ELSE {_rut('k', 9_000_000, 1_000_000)} END AS tenant,
    CASE WHEN k % 113 = 0 THEN '9' WHEN k % 3 <> 0 THEN '2' ELSE '1' END AS furnished,
    CASE WHEN k % 127 = 0 THEN '7' WHEN k % 4 = 0 THEN '2' ELSE (k % 6 + 1)::VARCHAR END AS use_code,
    CASE WHEN k % 2 = 0 THEN 'X' ELSE '' END AS dfl2,
    CASE WHEN k % 131 = 0 THEN 'x' WHEN k % 5 = 0 THEN '2' ELSE '1' END AS nature,
    {_UPS}
  FROM props JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
rent AS (SELECT *, ({_U_SUM})::BIGINT AS total FROM base)"""
_RENT_FLAGS = ", ".join(f"{_flag(f'r{i + 1} > 0')} AS \"{m}\"" for i, m in enumerate(MONTHS))


def _rent_list(tenant: str, extra: str = "") -> str:
    return f"""SELECT row_number() OVER (ORDER BY landlord_no, roll1, roll2, row_no) AS "Numero",
        roll1 AS "Rol_Parte_1", roll2 AS "Rol_Parte_2", code AS "Codigo_Comuna", commune AS "Comuna",
        landlord AS "Rut_Arrendador", {tenant} AS "Rut_Arrendatario_DJ", total AS "Monto_Arriendo",
        {_RENT_FLAGS}, furnished AS "Amoblado", use_code AS "Destino_Arriendo", dfl2 AS "DFL2",
        nature AS "Naturaleza_Bien_Raiz"{extra} FROM rent WHERE total > 0"""


def _rent_issues(intermediary: bool) -> str:
    rules = [
        ("E", "roll", "k % 101 = 0", "falta completar el Rol del Bien Raíz."),
        ("E", "commune_code", "k % 103 = 0", "falta código de comuna."),
        ("E", "commune_name", "k % 107 = 0", "falta nombre de comuna."),
        ("E", "landlord_rut", "k % 109 = 0", "RUT arrendador inválido o incompleto."),
        ("E", "amount", "total <= 0", "el monto anual de arriendo es cero."),
        ("E", "furnished", "furnished NOT IN ('1', '2')", "Amoblado debe ser 1 o 2."),
        ("E", "use", "use_code NOT IN ('1', '2', '3', '4', '5', '6')",
         "Destino del arriendo debe ser un código entre 1 y 6."),
        ("E", "nature", "nature NOT IN ('1', '2')", "Naturaleza del bien raíz debe ser 1 o 2."),
        ("W", "no_month", f"({_R_SUM}) <= 0", "no tiene meses con monto informado."),
    ]
    if intermediary:
        rules.append(("E", "tenant_rut", "k % 4 = 0", "RUT arrendatario inválido o incompleto."))
    return " UNION ALL ".join(
        f"SELECT row_no, '{sev}' AS severity, '{rule}' AS rule, "
        f"'Fila ' || row_no::VARCHAR || ': {text}' AS message FROM rent WHERE {condition}"
        for sev, rule, condition, text in rules
    )


def _rent_sql() -> dict[str, str]:
    w = f"WITH {_RENT_CTE} "
    ups = ", ".join(f"u{i + 1} AS \"Actualizado_{m}\"" for i, m in enumerate(MONTHS))
    same = ", ".join(f"r{i + 1} AS \"Actualizado_{m}\"" for i, m in enumerate(MONTHS))
    amounts = ", ".join(
        f"{'0::BIGINT' if m == 'DIC' else f'r{i + 1}'} AS \"Monto_{m}\"" for i, m in enumerate(MONTHS)
    )
    return {
        "rut_normalize_check": w + """SELECT row_no, landlord AS rut, k % 109 <> 0 AS valid,
            landlord_no::BIGINT AS rut_order, nullif(landlord_no, 0)::BIGINT AS rut_order_raw FROM rent""",
        "rent_conform_defaults": w + f"""SELECT row_no, roll1 AS "Rol_Parte_1", roll2 AS "Rol_Parte_2",
            code AS "Codigo_Comuna", commune AS "Comuna", landlord AS "Rut_Arrendador",
            tenant AS "Rut_Arrendatario", {amounts}, furnished AS "Amoblado", use_code AS "Destino_Arriendo",
            dfl2 AS "DFL2", nature AS "Naturaleza_Bien_Raiz" FROM rent""",
        "rent_index_wide": w + f"""SELECT row_no, {ups}, total AS "Monto_Arriendo", {_RENT_FLAGS} FROM rent""",
        "rent_index_off": w + f"""SELECT row_no, {same}, ({_R_SUM})::BIGINT AS "Monto_Arriendo" FROM rent""",
        "rent_issues": w + _rent_issues(False),
        "rent_issues_intermediary": w + _rent_issues(True),
        "rent_gate": w + f"""SELECT rule, count(*) AS n FROM ({_rent_issues(True)}) WHERE severity = 'E' GROUP BY rule""",
        "rent_sheet_scan": w + """SELECT row_number() OVER (ORDER BY row_no)
              + coalesce(sum(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_no,
            roll1 AS "Rol_Parte_1", roll2 AS "Rol_Parte_2", commune AS "Comuna", landlord AS "Rut_Arrendador", r1 AS "Monto_ENE",
            furnished AS "Amoblado", dfl2 AS "DFL2" FROM rent""",
        "rent_return": w + _rent_list("''", """, roll1 || '-' || roll2 AS "Rol" """),
        "rent_return_intermediary": w + _rent_list("tenant"),
        "rent_summary": w + _rows("rent WHERE total > 0", [
            ("Total de casos informados", "count(*)"),
            ("Total de Monto Arriendo", "coalesce(sum(total), 0)"),
        ]),
    }


# ---- payroll -----------------------------------------------------------------


def _some(n: int, expr: str) -> str:
    return f"CASE WHEN k % {n} = 0 THEN {expr} ELSE 0 END::BIGINT"


def _inferred(amount: str) -> str:
    """Income behind a tax as a correlated pick of the one bracket that holds it."""
    n = f"({amount} * 1000 + (br.r * 1000)::BIGINT * q.utm)::HUGEINT"
    k = "(br.f * 1000)::HUGEINT"
    return f"""(SELECT ((2 * {n} + {k}) // (2 * {k}))::BIGINT FROM br
        WHERE br.f > 0 AND {amount} > 0 AND 10 * {n} > (br.lo * 10)::HUGEINT * q.utm * {k}
          AND (br.hi IS NULL OR 10 * {n} <= (br.hi * 10)::HUGEINT * q.utm * {k}))"""


def _tax(income: str) -> str:
    return f"""(SELECT CASE WHEN br.f = 0 THEN 0 ELSE greatest(round({income} * br.f - br.r * q.utm), 0) END::BIGINT
        FROM br WHERE {income} > br.lo * q.utm AND (br.hi IS NULL OR {income} <= br.hi * q.utm))"""


_PAY_CTE = f"""
{_PARAM_CTE},
q AS (
  SELECT o_orderkey AS k, o_custkey AS c, floor(o_totalprice)::BIGINT AS price, p.*
  FROM orders JOIN p ON month(o_orderdate) = month_no),
q2 AS (SELECT *, price * 30 AS hab, (price * 30) // 5 AS cot FROM q),
num AS (
  SELECT q.*, coalesce({_tax('(q.hab - q.cot)')}, 0) AS tax,
    {_some(29, 'k % 1000 + 12345')} AS sev, {_some(31, '1000')} AS back, {_some(37, '-500')} AS diff,
    {_some(19, 'price // 100')} AS extra, {_some(23, 'price // 50')} AS loan,
    {_some(13, 'price // 10')} AS zone, {_some(7, 'price // 20')} AS un1, {_some(5, 'price // 30')} AS un2,
    hab // 25 AS emp, price // 200 AS hx, price // 300 AS sav
  FROM q2 AS q),
tot AS (SELECT *, tax + sev + back + diff AS taxes, greatest(hab - cot, 0) AS fb FROM num),
inf AS (SELECT q.*, {_inferred('q.taxes')} AS inferred FROM tot AS q),
net AS (SELECT *, CASE WHEN sev > 0 THEN fb ELSE coalesce(inferred, fb) END AS net FROM inf),
lin AS (
  SELECT *, net + zone AS inc, un1 + un2 AS ng, cot + emp AS law, k % 17 = 0 AS ended,
    CASE WHEN k % 11 = 0 THEN 99 ELSE 40 END AS hours,
    CASE WHEN k % 17 = 0 THEN 'F' WHEN net + zone > 0 THEN 'C' ELSE '' END AS period,
    CASE WHEN inferred IS NOT NULL THEN 'Inferida desde IUSC' ELSE 'Fallback LRE' END AS method,
    'lre_' || word || '_' || (k % 3)::VARCHAR || '.csv' AS file,
    CASE WHEN c % 211 = 0 THEN '' ELSE {_rut('c', 80_000_000, 10_000_000)} END AS worker,
    round(net * factor)::BIGINT AS net_up, round(taxes * factor)::BIGINT AS taxes_up,
    round(extra * factor)::BIGINT AS extra_up, round(ng * factor)::BIGINT AS ng_up,
    round(zone * factor)::BIGINT AS zone_up, round(loan * factor)::BIGINT AS loan_up,
    round(hab * factor)::BIGINT AS hab_up, 0::BIGINT AS zero
  FROM net)"""

_MONTH_COLUMNS = {
    "Renta_Total_Neta_Mensual": "net", "Renta_Inferida_IUSC": "inferred", "Renta_LRE_Fallback": "fb",
    "Monto_Ingreso_Mensual_Sin_Actualizar": "inc", "IUSC": "tax", "IUSC_Indemnizaciones": "sev",
    "IUSC_Total_Mensual": "taxes", "Mayor_Retencion": "extra", "Renta_No_Gravada_Mensual": "ng",
    "Renta_Exenta_Mensual": "zero", "Rebaja_Zona_Extrema": "zone", "Prestamo_3": "loan",
    "Leyes_Sociales": "law", "Total_Haberes_Imp_Trib": "hab", "Cotizaciones_Deducibles_Renta_Neta": "cot",
    "Cot_Salud_Voluntaria": "hx", "APVI_Mod_B": "sav", "Renta_Total_Neta_Actualizada": "net_up",
    "IUSC_Actualizado": "taxes_up", "Mayor_Retencion_Actualizada": "extra_up",
    "Renta_No_Gravada_Actualizada": "ng_up", "Renta_Exenta_Actualizada": "zero",
    "Rebaja_Zona_Extrema_Actualizada": "zone_up", "Prestamo_3_Actualizado": "loan_up",
    "Remuneracion_Imponible_Prev_Actualizada": "hab_up",
}
_MONTH_SELECT = ", ".join(f"coalesce(sum({s}), 0)::BIGINT AS \"{n}\"" for n, s in _MONTH_COLUMNS.items())
_MONTH_CTE = f"""
{_PAY_CTE},
wm AS (
  SELECT worker AS "Rut_Trabajador", month AS "MES_DJ", {_MONTH_SELECT},
    coalesce(arg_min(period, k) FILTER (period <> ''), '') AS "Periodo_DJ", max(hours)::INT AS "Horas_Semanales",
    string_agg(DISTINCT file, ' | ' ORDER BY file) AS "ARCHIVO_ORIGEN",
    string_agg(DISTINCT method, ' / ' ORDER BY method) AS "Metodo_Renta"
  FROM lin GROUP BY worker, month)"""

_LIST_SUMS = [
    "Renta_Total_Neta_Actualizada", "IUSC_Actualizado", "Mayor_Retencion_Actualizada",
    "Renta_No_Gravada_Actualizada", "Renta_Exenta_Actualizada", "Rebaja_Zona_Extrema_Actualizada",
    "Prestamo_3_Actualizado", "Renta_Total_Neta_Mensual", "IUSC_Total_Mensual", "Renta_No_Gravada_Mensual",
    "Renta_Exenta_Mensual", "Rebaja_Zona_Extrema", "Prestamo_3", "Leyes_Sociales",
    "Remuneracion_Imponible_Prev_Actualizada",
]
_PERIODS = ", ".join(
    f"coalesce(max(\"Periodo_DJ\") FILTER (\"MES_DJ\" = '{m}'), '') AS \"{m}\"" for m in MONTHS
)
_INCOMES = ", ".join(
    f"coalesce(sum(\"Monto_Ingreso_Mensual_Sin_Actualizar\") FILTER (\"MES_DJ\" = '{m}'), 0)::BIGINT AS \"Ingreso_{m}\""
    for m in MONTHS
)
_SUMMARY = {
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


def _pay_sql() -> dict[str, str]:
    w = f"WITH {_PAY_CTE} "
    m = f"WITH {_MONTH_CTE} "
    sums = ", ".join(f'sum("{c}")::BIGINT AS "{c}"' for c in _LIST_SUMS)
    number = """row_number() OVER (ORDER BY coalesce(try_cast(split_part("Rut_Trabajador", '-', 1) AS BIGINT), 0),
        "Rut_Trabajador")"""
    return {
        "tax_forward": w + "SELECT k AS o_orderkey, month, hab AS earnings, cot AS contributions, tax FROM num",
        "tax_inverse": w + f"""SELECT k AS o_orderkey, price - 5000 AS tax, {_inferred('(q.price - 5000)')} AS income
            FROM q""",
        "tax_roundtrip": w + "SELECT k AS o_orderkey, price AS tax, price AS again FROM q",
        "tax_bracket_join": w + """SELECT k AS o_orderkey, month, hab AS earnings, (br.f * 1000)::BIGINT AS factor_milli,
            ((br.r * 100)::BIGINT * utm)::BIGINT AS rebate_cents
            FROM num LEFT JOIN br ON hab > br.lo * utm AND (br.hi IS NULL OR hab <= br.hi * utm)""",
        "month_parameter_join": w + """SELECT k AS o_orderkey, month, utm, round(hab * factor)::BIGINT AS restated
            FROM num""",
        "payroll_net_income": w + """SELECT k AS ord, fb AS "Renta_LRE_Fallback", taxes AS "IUSC_Total_Mensual",
            inferred AS "Renta_Inferida_IUSC", net AS "Renta_Total_Neta_Mensual", method AS "Metodo_Renta",
            ng AS "Renta_No_Gravada_Mensual", zero AS "Renta_Exenta_Mensual",
            inc AS "Monto_Ingreso_Mensual_Sin_Actualizar", law AS "Leyes_Sociales",
            net_up AS "Renta_Total_Neta_Actualizada", taxes_up AS "IUSC_Actualizado",
            extra_up AS "Mayor_Retencion_Actualizada", ng_up AS "Renta_No_Gravada_Actualizada",
            zone_up AS "Rebaja_Zona_Extrema_Actualizada", loan_up AS "Prestamo_3_Actualizado",
            hab_up AS "Remuneracion_Imponible_Prev_Actualizada" FROM lin""",
        "payroll_period_hours": w + """SELECT k AS ord, ended AS "Tiene_Termino", hours::INT AS "Horas_Semanales",
            period AS "Periodo_DJ" FROM lin""",
        "payroll_optional_columns": w + f"""SELECT k AS ord, coalesce({_inferred('q.tax')}, hab)
            AS "Renta_Total_Neta_Mensual", 0::BIGINT AS "Leyes_Sociales", false AS "Tiene_Termino",
            40::INT AS "Horas_Semanales",
            CASE WHEN coalesce({_inferred('q.tax')}, hab) > 0 THEN 'C' ELSE '' END AS "Periodo_DJ"
            FROM num AS q""",
        "payroll_worker_month": m + "SELECT * FROM wm",
        "payroll_file_sets": w + """SELECT worker AS "Rut_Trabajador", month AS "MES_DJ", sum(tax)::BIGINT AS "IUSC",
            string_agg(DISTINCT replace(file, '.csv', '_' || (k % 42)::VARCHAR || '.csv'), ' | '
              ORDER BY replace(file, '.csv', '_' || (k % 42)::VARCHAR || '.csv')) AS "ARCHIVO_ORIGEN" FROM lin GROUP BY 1, 2""",
        "book_required_columns": w + f"""SELECT book, month AS "MES_DJ", count(*) AS rows, refused FROM num, (VALUES ('whole', ''),
            ('no tax', 'missing required columns: {_TAX}'), ('no worker, no tax', 'missing required columns: {_WORKER}, {_TAX}')) AS b(book, refused)
            GROUP BY ALL""",
        "payroll_period_pivot": m + f'SELECT "Rut_Trabajador", {_PERIODS} FROM wm GROUP BY 1',
        "payroll_income_pivot": m + f'SELECT "Rut_Trabajador", {_INCOMES} FROM wm GROUP BY 1',
        "payroll_return": m + f"""SELECT {number} AS "Numero", {number} AS "Numero_Certificado", * FROM (
            SELECT "Rut_Trabajador", {sums}, {_PERIODS}, {_INCOMES}, max("Horas_Semanales") AS "Horas_Semanales",
            'Calculada' AS "ESTADO" FROM wm GROUP BY 1)""",
        "payroll_summary": m + _rows("wm", [
            ("Total Casos Informados", 'count(DISTINCT "Rut_Trabajador")'),
            *[(label, f'sum("{c}")') for label, c in _SUMMARY.items()],
            *[(f"Ingreso Mensual {mm} Sin Actualizar",
               f"coalesce(sum(\"Monto_Ingreso_Mensual_Sin_Actualizar\") FILTER (\"MES_DJ\" = '{mm}'), 0)")
              for mm in MONTHS],
        ]),
        "payroll_blank_workers": m + """SELECT "MES_DJ", 'W' AS severity, 'blank_rut' AS rule,
            'rows without a worker RUT' AS message FROM wm WHERE "Rut_Trabajador" = '' """,
        "payroll_book_scan": w + f"""SELECT
            CASE WHEN c % 211 <> 0 THEN {_dots('c % 80000000 + 10000000')} || '-' || {_char('c')} END AS rut,
            CASE WHEN k % 17 = 0 THEN '31/12/2025' WHEN k % 3 = 0 THEN 'NaT' END AS contract_end,
            CASE WHEN k % 3 = 0 THEN '$ ' || {_dots('hab')} || ',00' ELSE hab::VARCHAR END AS earnings,
            tax::VARCHAR AS tax, emp::VARCHAR AS employer, month, 'book=lre_' || word AS file FROM num""",
        "payroll_book_quoted": w + f"""SELECT
            CASE WHEN c % 211 <> 0 THEN {_dots('c % 80000000 + 10000000')} || '-' || {_char('c')} END AS rut,
            CASE WHEN k % 17 = 0 THEN '31/12/2025' || chr(10) || 'de mutuo acuerdo; "art. 159"' || chr(13) || chr(10) || chr(10) || 'firmado'
                WHEN k % 3 = 0 THEN 'NaT' END AS contract_end,
            CASE WHEN k % 3 = 0 THEN '$ ' || {_dots('hab')} || ',00' ELSE hab::VARCHAR END AS earnings,
            emp::VARCHAR AS employer, month, 'book=lre_' || word AS file FROM num""",
        "payroll_book_rejects": w + f"""SELECT 'book=lre_' || word AS file, 23::INT AS cells, 21::INT AS expected,
            CASE WHEN c % 211 <> 0 THEN {_dots('c % 80000000 + 10000000')} || '-' || {_char('c')} ELSE ' ' END AS rut
            FROM num WHERE k % 97 = 0""",
        "payroll_book_many": w + f"""SELECT
            CASE WHEN c % 211 <> 0 THEN {_dots('c % 80000000 + 10000000')} || '-' || {_char('c')} END AS rut,
            tax::VARCHAR AS tax, month FROM num""",
        "union_of_books": w + """SELECT k AS o_orderkey, hab AS earnings,
            CASE WHEN month_no <= 6 THEN tax END AS tax, CASE WHEN month_no > 6 THEN loan END AS loan FROM num""",
    }


# ---- scalars, sources, months ------------------------------------------------

_W = "w"
_HALF_EVEN = "CASE WHEN cc > 50 THEN w + 1 WHEN cc < 50 THEN w ELSE w + w % 2 END"
# Per notation: text, fee-report value, rental-sheet value, payroll value.
_SHAPES = [
    ("NULL", "0", "0", "0"),
    ("' - '", "0", "0", "0"),
    ("' ' || w || ' '", "w", "w", "w"),
    ("w || '.00'", "w", "w * 100", "w"),
    (f"'$ ' || {_dots('w')} || ',' || lpad(cc::VARCHAR, 2, '0')", "0", "0", _HALF_EVEN),
    (_dots("w"), "CASE WHEN w < 1000 THEN w WHEN w < 1000000 THEN w // 1000 ELSE 0 END", "w",
     "CASE WHEN w >= 1000 AND w < 1000000 AND w % 1000 = 0 THEN w // 1000 ELSE w END"),
    ("format('{:,}', w)", "w", "w", "w"),
    ("w || '.' || lpad(cc::VARCHAR, 2, '0')", "w", "w * 100 + cc", _HALF_EVEN),
    ("w || ',' || lpad(cc::VARCHAR, 2, '0')", "w * 100 + cc", "w * 100 + cc", _HALF_EVEN),
    ("w || '.5'", "w", "w * 10 + 5", "w + w % 2"),
    ("'-' || w || '.000'", "-w", "-w * 1000", "-w"),
    (f"'-' || {_dots('w')}", "CASE WHEN w < 1000 THEN -w WHEN w < 1000000 THEN -(w // 1000) ELSE 0 END", "-w",
     "CASE WHEN w >= 1000 AND w < 1000000 AND w % 1000 = 0 THEN -(w // 1000) ELSE -w END"),
    ("'n' || w", "0", "0", "0"),
    ("w || 'e1'", "w * 10", "w * 10", "w * 10"),
]


def _amount_sql(which: int) -> str:
    text = " ".join(f"WHEN {i} THEN {s[0]}" for i, s in enumerate(_SHAPES))
    value = " ".join(f"WHEN {i} THEN {s[which]}" for i, s in enumerate(_SHAPES))
    return f"""WITH s AS (SELECT *, floor(l_extendedprice)::BIGINT AS w, l_orderkey % 100 AS cc,
        ((l_orderkey + l_linenumber) % {len(_SHAPES)})::INT AS shape FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, CASE shape {text} END AS text,
        (CASE shape {value} END)::BIGINT AS amount FROM s"""


def _other_sql() -> dict[str, str]:
    books = f"""WITH {_PARAM_CTE}, f AS (
        SELECT o_custkey, CASE WHEN o_orderkey % 40 <> 0 THEN month(o_orderdate) END AS m FROM orders),
        c AS (SELECT o_custkey, min(m) AS first_m, list(DISTINCT m) FILTER (m IS NOT NULL) AS seen,
              count(*) FILTER (m IS NULL) AS undetected FROM f GROUP BY 1),
        twice AS (SELECT o_custkey, list(m) AS ms FROM (
              SELECT o_custkey, m FROM f WHERE m IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) """

    def codes(condition: str) -> str:
        return f"coalesce((SELECT string_agg(month, ', ' ORDER BY month_no) FROM p WHERE {condition}), '')"

    supplier_name = "CASE WHEN s_suppkey % 9 <> 0 THEN replace(s_name, '#', ' ') END"
    supplier_rut = f"CASE WHEN s_suppkey % 7 <> 0 THEN {_rut('s_suppkey', 80_000_000, 10_000_000)} END"
    word = f"(list_value({', '.join(repr(x) for x in MONTH_WORDS)}))[month(o_orderdate)]"
    codes_list = f"(list_value({', '.join(repr(x) for x in MONTHS)}))"
    return {
        "html_cell_extract": """WITH u AS (
            SELECT page_id, unnest(ls) AS ul, generate_subscripts(ls, 1) - 1 AS row_no FROM (
              SELECT page_id, regexp_extract_all(html, '(?s)<ul[^>]*>(.*?)</ul>', 1) AS ls FROM pages)),
            c AS (SELECT page_id, row_no, unnest(cs) AS cell, generate_subscripts(cs, 1) - 1 AS col_no FROM (
              SELECT page_id, row_no, regexp_extract_all(ul, '(?s)<li[^>]*>(.*?)</li>', 1) AS cs FROM u))
            SELECT page_id, row_no::INT AS row_no, col_no::INT AS col_no, nullif(trim(
              replace(replace(replace(replace(regexp_replace(cell, '<[^>]*>', '', 'g'),
              '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')), '') AS text FROM c""",
        "month_from_filename": f"""SELECT o_orderkey,
            CASE WHEN o_orderkey % 7 = 0 THEN 'libro_mayor_' ELSE 'Libro_' END ||
            CASE WHEN o_orderkey % 10 = 0 THEN 'resumen'
                 WHEN o_orderkey % 10 = 1 AND month(o_orderdate) = 9 THEN 'SETIEMBRE' ELSE {word} END ||
            '_' || o_orderkey::VARCHAR || '.csv' AS file,
            CASE WHEN o_orderkey % 7 = 0 AND (o_orderkey % 10 = 0 OR month(o_orderdate) > 4) THEN 'MAY'
                 WHEN o_orderkey % 10 = 0 THEN NULL ELSE {codes_list}[month(o_orderdate)] END AS month
            FROM orders""",
        "contributor_extract": f"""SELECT s_suppkey,
            coalesce({supplier_name}, 'No disponible') AS "Nombre_Empresa_Declarante",
            coalesce({supplier_rut}, 'No disponible') AS "Rut_Empresa_Declarante" FROM supplier""",
        "last_declarant": f"""WITH s AS (
            SELECT *, {supplier_name} AS name, {supplier_rut} AS rut FROM supplier)
            SELECT s_nationkey,
            coalesce(arg_max(name, s_suppkey) FILTER (name IS NOT NULL), 'No disponible') AS "Nombre_Empresa_Declarante",
            coalesce(arg_max(rut, s_suppkey) FILTER (rut IS NOT NULL), 'No disponible') AS "Rut_Empresa_Declarante"
            FROM s GROUP BY s_nationkey""",
        "amount_coerce": _amount_sql(1),
        "amount_clean_plain": _amount_sql(2),
        "amount_clean_locale": _amount_sql(3),
        "amount_format": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN '0'
            ELSE {_dots('floor(o_totalprice)::BIGINT * (o_orderkey % 3 - 1)')} END AS shown FROM orders""",
        "receipt_date_month": """WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderkey % 5)::INT AS kind FROM orders),
            x AS (SELECT *, CASE kind WHEN 0 THEN strftime(d, '%d/%m/%Y')
              WHEN 1 THEN day(d) || '/' || month(d) || '/' || year(d)
              WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN '31/' || strftime(d, '%m/%Y') END AS text FROM t)
            SELECT o_orderkey, text, try_strptime(text, '%d/%m/%Y')::DATE AS date,
            month(try_strptime(text, '%d/%m/%Y'))::INT AS month_no FROM x""",
        "month_gaps": books + f"""SELECT o_custkey, (SELECT month FROM p WHERE month_no = first_m) AS first_month,
            {codes('list_contains(c.seen, p.month_no)')} AS present,
            {codes('p.month_no >= c.first_m AND NOT list_contains(c.seen, p.month_no)')} AS missing FROM c""",
        "month_duplicates": books + f"""SELECT o_custkey, {codes('list_contains(twice.ms, p.month_no)')} AS duplicated,
            undetected FROM c LEFT JOIN twice USING (o_custkey)""",
    }


def all_sql() -> dict[str, str]:
    return {**_fee_sql(), **_rent_sql(), **_pay_sql(), **_other_sql()}
