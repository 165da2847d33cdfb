"""Words, tables and broadcast checks shared by the text operators.

A word is a maximal run of characters other than the six ASCII white space
characters (space, tab, line feed, vertical tab, form feed, carriage return).
A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anualia.scratch import materialize

SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"

# Rows of a table that may be broadcast; at some 100 bytes a row this is 50 MB.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 50_000_000  # where rows have no bound of their own
SALTS = 8
HOT_ROWS = 1 << 18  # a key with more rows is joined apart


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; one stored in fewer splits than there are cores is spread out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def split_words(text: Column, gap: str = GAP, trim: str = SPACES) -> Column:
    """The words of a text, in order; empty for null and blank texts."""
    stripped = F.btrim(text, F.lit(trim))
    return F.when(F.length(stripped) > 0, F.split(stripped, gap)).otherwise(F.array().cast("array<string>"))


def small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether the frame is small enough to be broadcast; counts at most one row more than that."""
    limit = BROADCAST_ROWS if rows is None else rows
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint behind a count; a larger frame joins by shuffle."""
    return F.broadcast(df) if small(df, rows) else df.hint("merge")


def salted_join(rows: DataFrame, table: DataFrame, key: str, spread: Column) -> DataFrame:
    """Inner join for a ``table`` beyond the broadcast bound whose keys may be those of a great share of ``rows``.

    ``spread``, an expression over ``rows``, tells the rows of one key apart; they
    are dealt to ``SALTS`` parts, each of which has every row of the table.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", salt).join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def hot_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join by shuffle with a table that has a key once; keys on more than ``HOT_ROWS`` rows are broadcast.

    There is at most one such key for each ``HOT_ROWS`` rows. ``rows`` and ``table`` are read twice.
    """
    often = rows.groupBy(key).agg(F.count("*").alias("_times")).where(F.col("_times") > HOT_ROWS).select(key)
    often = materialize(often, "hot-keys")
    few = F.broadcast(often)
    hot = rows.join(F.broadcast(table.join(few, key)), key)
    return rows.join(few, key, "left_anti").join(table.hint("merge"), key).unionByName(hot)


def join_small(rows: DataFrame, table: DataFrame, key: str, spread: Column, size: Column | None = None) -> DataFrame:
    """Inner join by broadcast if the table is within the bound, else by a salted shuffle.

    ``size`` are the bytes of a row of the table where these have no bound.
    """
    fits = small(table)
    if fits and size is not None:
        fits = (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(table), key) if fits else salted_join(rows, table, key, spread)


def hashed_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About ``rows`` rows, at most that many: those with the least hash of their key.

    A threshold on the hash picks them, so a task sends its share to the driver,
    not its own first rows.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(1 << 31))
    share = min(1.0, 1.2 * rows / max(df.count(), 1))
    return df.where(place < int(share * (1 << 31))).orderBy(place, *key).limit(rows)


def parts(batch: pa.RecordBatch, column: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of one text column; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    first = 0
    while first < batch.num_rows:
        done = sizes[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(sizes, done + size)))
        yield batch.slice(first, stop - first)
        first = stop
