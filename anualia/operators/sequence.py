"""Running numbers 1..n over a sorted list of any size.

``row_number()`` over a global window sends every row to one task. Here the rows
are range-sorted over the whole cluster and written once with their position
inside their own range; the row counts of the ranges (one row per range) then
give each range its offset. The data is shuffled once and never sits in one
task, however hot a single sort key is, as long as the keys end in a column that
tells rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anualia.scratch import materialize

_POSITION_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def sort_by(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Global sort whose keys are computed once per row, not once per comparison."""
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.select("*", *[key.alias(n) for key, n in zip(keys, names)])
    return keyed.orderBy(*[F.col(n).asc_nulls_last() for n in names]).drop(*names)


def number_rows(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Add ``name`` = 1..n in the order of ``keys``; the keys must be a total order."""
    # A range sort looks at its input twice, once for the bounds; written first, costly rows are computed once.
    ordered = sort_by(materialize(df, "unnumbered"), keys).withColumn("_id", F.monotonically_increasing_id())
    placed = materialize(ordered, "numbered")

    part = F.shiftright("_id", _POSITION_BITS)
    local = F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local + 1)
        .drop("_part", "_offset", "_id")
        .select(name, *df.columns)
    )
