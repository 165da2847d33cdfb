"""SQL text as building blocks.

Rules that apply to dozens of columns are written as SQL text over ``{x}``: one
parsed expression per column is far cheaper to build than a tree of Column
objects. Inside a rule, a value needed more than once is bound to the variable of
a one-element ``transform``, so that it is computed once and the generated code
stays small enough for the JVM to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote(text: str) -> str:
    """SQL literal taken as written, without escapes."""
    mark = "'" if "'" not in text else '"'
    return f"r{mark}{text}{mark}"


def name(column: str) -> str:
    """Column name that may hold dots or blanks, as SQL text."""
    return "`" + column.replace("`", "``") + "`"


def apply(rule: str, x: str | Column) -> Column:
    """A rule over ``{x}`` on SQL text or on a Column."""
    if isinstance(x, str):
        return F.expr(rule.replace("{x}", x))
    body = F.expr("_x -> " + rule.replace("{x}", "_x"))
    return F.get(F.call_function("transform", F.array(x), body), F.lit(0))


def with_computed(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections reuse, never recompute.

    The value is computed in a projection of its own. The one-element ``explode``
    on top keeps the optimizer from copying a costly expression into every filter
    or column that refers to it.
    """
    computed = df.select("*", value.alias("_value"))
    return computed.select(*[name(c) for c in df.columns], F.explode(F.array("_value")).alias(column))


def select_computed(df: DataFrame, keep: list[str], values: dict[str, Column]) -> DataFrame:
    """Select columns computed once, as ``with_computed`` does, in one step."""
    computed = df.select(*keep, *[value.alias(column) for column, value in values.items()])
    return computed.select(*keep, F.inline(F.array(F.struct(*values))))
