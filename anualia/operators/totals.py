"""Key-value summaries: one global aggregate turned into (Campo, Monto) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anualia.functions.template import quote


def total(column: str) -> str:
    """SQL text for the sum of a column; 0 over no rows."""
    return f"coalesce(sum({column}), 0L)"


def summary_table(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """One row per field, in the given order; a field is a label and an aggregate as SQL text."""
    totals = df.agg(*[F.expr(f"cast({agg} AS BIGINT) AS f{i}") for i, (_, agg) in enumerate(fields)])
    rows = ", ".join(
        f"named_struct('Campo', {quote(label)}, 'Monto', f{i})" for i, (label, _) in enumerate(fields)
    )
    return totals.select(F.expr(f"inline(array({rows}))"))
