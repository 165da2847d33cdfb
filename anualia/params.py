"""Yearly tax parameters and the options of one declaration.

Parameters are small, fixed-size values (12 months, 8 brackets). They reach the
plans as literals, which Catalyst folds, or as tiny tables for broadcast joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Month codes in calendar order.
MONTHS = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC")

# 2025 factors that restate a month's amount to 31 December.
FACTORS_2025 = {
    "ENE": "1.036",
    "FEB": "1.026",
    "MAR": "1.022",
    "ABR": "1.016",
    "MAY": "1.014",
    "JUN": "1.012",
    "JUL": "1.017",
    "AGO": "1.008",
    "SEP": "1.007",
    "OCT": "1.003",
    "NOV": "1.003",
    "DIC": "1.000",
}

# 2025 monthly tax unit (UTM) in pesos.
UTM_2025 = {
    "ENE": 67429,
    "FEB": 67294,
    "MAR": 68034,
    "ABR": 68306,
    "MAY": 68648,
    "JUN": 68785,
    "JUL": 68923,
    "AGO": 68647,
    "SEP": 69265,
    "OCT": 69265,
    "NOV": 69542,
    "DIC": 69542,
}

# Wage-tax schedule in UTM: (over, up to and including, factor, rebate).
BRACKETS_2025 = (
    ("0", "13.5", "0", "0"),
    ("13.5", "30", "0.04", "0.54"),
    ("30", "50", "0.08", "1.74"),
    ("50", "70", "0.135", "4.49"),
    ("70", "90", "0.23", "11.14"),
    ("90", "120", "0.304", "17.80"),
    ("120", "150", "0.35", "23.32"),
    ("150", None, "0.40", "30.82"),
)

# Withholding rate on fees and rate of the loan refund.
FEE_RATE = "0.145"
LOAN_RATE = "0.03"


def _scaled(text: str, scale: int) -> int:
    """Exact integer value of ``text * scale``; raises if it has more decimals."""
    value = Decimal(text) * scale
    if value != value.to_integral_value():
        raise ValueError(f"{text} has more decimals than a scale of {scale} holds")
    return int(value)


@dataclass(frozen=True)
class Bracket:
    """One tax bracket in whole units: tenths of UTM, thousandths, hundredths of UTM."""

    over_tenths: int
    upto_tenths: int | None
    factor_milli: int
    rebate_cents: int


@dataclass(frozen=True)
class YearParameters:
    """All parameters of one commercial year, months in calendar order."""

    commercial_year: int
    factor_milli: tuple[int | None, ...]  # none for months that have no factor yet
    utm: tuple[int | None, ...]
    brackets: tuple[Bracket, ...]
    fee_rate_milli: int
    loan_rate_milli: int

    def __post_init__(self) -> None:
        if len(self.factor_milli) != 12 or len(self.utm) != 12:
            raise ValueError("a parameter year needs 12 factors and 12 UTM values")

    @property
    def tax_year(self) -> int:
        return self.commercial_year + 1

    @property
    def missing_months(self) -> list[str]:
        """Codes of the months without factor or UTM."""
        return [m for m, f, u in zip(MONTHS, self.factor_milli, self.utm) if f is None or u is None]

    def complete(self) -> YearParameters:
        """Return self, or raise if a month has no factor or UTM."""
        if self.missing_months:
            raise ValueError(f"no parameters for {', '.join(self.missing_months)} of {self.commercial_year}")
        return self

    def month_table(self, spark: SparkSession) -> DataFrame:
        """Twelve rows: year, month code, month number, factor, UTM."""
        schema = T.StructType([
            T.StructField("commercial_year", T.IntegerType(), False),
            T.StructField("month", T.StringType(), False),
            T.StructField("month_no", T.IntegerType(), False),
            T.StructField("factor", T.DecimalType(4, 3), True),
            T.StructField("utm", T.LongType(), True),
        ])
        rows = [
            (self.commercial_year, code, i + 1, None if f is None else Decimal(f) / 1000, u)
            for i, (code, f, u) in enumerate(zip(MONTHS, self.factor_milli, self.utm))
        ]
        return spark.createDataFrame(rows, schema)

    def bracket_table(self, spark: SparkSession) -> DataFrame:
        """Twelve months times the taxed and exempt brackets, bounds in tenths of pesos."""
        schema = T.StructType([
            T.StructField("month", T.StringType(), False),
            T.StructField("utm", T.LongType(), False),
            T.StructField("over_tenths", T.LongType(), False),
            T.StructField("upto_tenths", T.LongType(), True),
            T.StructField("factor_milli", T.LongType(), False),
            T.StructField("rebate_cents", T.LongType(), False),
        ])
        rows = [
            (
                code,
                utm,
                b.over_tenths * utm,
                None if b.upto_tenths is None else b.upto_tenths * utm,
                b.factor_milli,
                b.rebate_cents * utm,
            )
            for code, utm in zip(MONTHS, self.complete().utm)
            for b in self.brackets
        ]
        return spark.createDataFrame(rows, schema)


def year_parameters(
    commercial_year: int,
    factors: dict[str, str],
    utm: dict[str, int],
    brackets: tuple[tuple[str, str | None, str, str], ...],
    fee_rate: str = FEE_RATE,
    loan_rate: str = LOAN_RATE,
) -> YearParameters:
    """Build a parameter year from values as published (decimal text); months may be absent while the year runs."""
    return YearParameters(
        commercial_year=commercial_year,
        factor_milli=tuple(_scaled(factors[m], 1000) if m in factors else None for m in MONTHS),
        utm=tuple(utm.get(m) for m in MONTHS),
        brackets=tuple(
            Bracket(
                _scaled(over, 10),
                None if upto is None else _scaled(upto, 10),
                _scaled(factor, 1000),
                _scaled(rebate, 100),
            )
            for over, upto, factor, rebate in brackets
        ),
        fee_rate_milli=_scaled(fee_rate, 1000),
        loan_rate_milli=_scaled(loan_rate, 1000),
    )


_YEARS = {2025: year_parameters(2025, FACTORS_2025, UTM_2025, BRACKETS_2025)}

DEFAULT_YEAR = 2025


def for_year(commercial_year: int = DEFAULT_YEAR) -> YearParameters:
    """Parameters of a year; an unknown year is an error, never a silent default."""
    if commercial_year not in _YEARS:
        known = ", ".join(str(y) for y in sorted(_YEARS))
        raise ValueError(f"no parameters for commercial year {commercial_year}; known: {known}")
    return _YEARS[commercial_year]


def register_year(parameters: YearParameters) -> None:
    """Add or replace the parameters of a year."""
    _YEARS[parameters.commercial_year] = parameters


def registered_years() -> list[YearParameters]:
    """The parameters of all years, by year."""
    return [_YEARS[y] for y in sorted(_YEARS)]


# Declarant types of the rent return.
TENANT = "Arrendatario"
INTERMEDIARY = "Corredor / intermediario / mandatario"
DECLARANT_TYPES = (TENANT, INTERMEDIARY)

# Years a payroll declarant can name for the full 40-hour week.
FULL_HOURS_YEARS = (2024, 2025, 2026, 2027, 2028)


@dataclass(frozen=True)
class Declaration:
    """Who declares, for which year, and with which options."""

    name: str
    rut: str
    commercial_year: int = DEFAULT_YEAR
    declarant_type: str = TENANT
    apply_index: bool = True
    full_hours_year: int = 2028
    email: str = ""
    address: str = ""
    commune: str = ""

    @property
    def tax_year(self) -> int:
        return self.commercial_year + 1

    def problems(self) -> list[str]:
        """Every reason why this declarant cannot file; empty when all is well."""
        from anualia.functions.rut import is_valid_text

        found = []
        if not self.name.strip():
            found.append("the declarant's name is empty")
        if not is_valid_text(self.rut):
            found.append("the declarant's RUT must look like 12345678-9")
        if self.declarant_type not in DECLARANT_TYPES:
            found.append(f"unknown declarant type: {self.declarant_type}")
        if self.full_hours_year not in FULL_HOURS_YEARS:
            found.append(f"year of the 40-hour week out of range: {self.full_hours_year}")
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """The declaration as one row."""
        row = [(self.name, self.rut, self.commercial_year, self.tax_year, self.declarant_type, self.full_hours_year, self.email, self.address, self.commune)]
        return spark.createDataFrame(
            row,
            "Nombre string, Rut string, Anio_Comercial int, Anio_Tributario int, Tipo_Declarante string, Anio_40_Horas int,"
            " Correo string, Domicilio string, Comuna string",
        )

    def checked(self) -> "Declaration":
        """Return self, or raise with every problem found."""
        found = self.problems()
        if found:
            raise ValueError("; ".join(found))
        return self
