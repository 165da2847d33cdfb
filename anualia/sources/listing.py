"""File lists: which files make up an input, and in which order.

Only file names pass through the driver, never file contents.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anualia.scratch import materialize

# Rows of a file list that may be broadcast; at some 200 bytes a row this is 20 MB.
BROADCAST_FILES = 100_000
# Bytes of small splits that one task reads.
TASK_BYTES = 32 << 20

_STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
_INPUTS = T.StructType([
    T.StructField("place", T.StringType(), False),
    T.StructField("input_no", T.IntegerType(), False),
    T.StructField("file_name", T.StringType(), False),
])


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def plain_path(file_path: Column) -> Column:
    """The path of a file as it is given to a reader, from its encoded form in the file metadata."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def _places(spark: SparkSession, inputs: Sequence[str]) -> list[str]:
    """Absolute paths of the inputs without their store."""
    bare = [re.sub(_STORE, "", p) for p in inputs]
    home = "/"
    if any(not p.startswith("/") for p in bare):
        jvm = spark._jvm
        store = jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        home = store.getWorkingDirectory().toUri().getPath()
    return [posixpath.normpath(posixpath.join(home, p)) for p in bare]


def list_files(spark: SparkSession, inputs: Sequence[str]) -> DataFrame:
    """Number the files of the inputs in the given order: file_path, file_no, input_no, file_name.

    An input is a file or a folder of part files; the files of a folder follow
    each other by path. ``file_name`` is the name of the input itself. All inputs
    are listed in one scan, whatever their number, and the list is written once.
    """
    rows = [(place, n, base_name(path)) for n, (place, path) in enumerate(zip(_places(spark, inputs), inputs))]
    given = spark.createDataFrame(rows, _INPUTS)
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
        .select("_metadata.file_path").distinct()
    )
    # A file belongs to the input that is the file itself or one of the folders above it.
    steps = F.split(F.regexp_replace(plain_path(F.col("file_path")), _STORE, ""), "/")
    above = found.select(
        "file_path",
        F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("place"),
    )
    # The only window without a partition: over file names.
    number = F.row_number().over(W.orderBy("input_no", "file_path")) - 1
    listed = above.join(given, "place").select("file_path", number.alias("file_no"), "input_no", "file_name")
    return materialize(listed, "files")


def with_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """Join rows with the list of their files by ``file_path``; a long list is not broadcast."""
    few = files.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    return df.join(F.broadcast(files) if few else files, "file_path")


def _bytes(size: str) -> int:
    """Bytes of a size as settings have it, such as ``64k`` or ``134217728b``."""
    number, unit = re.fullmatch(r"([0-9]+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * "kmgtp".find(unit) + 10 if unit else int(number)


def join_splits(df: DataFrame) -> DataFrame:
    """A scan of very small splits in fewer tasks, each of which reads whole splits, one after the other.

    Tasks read up to ``TASK_BYTES``, so their number grows with the files and not with the splits.
    """
    spark = df.sparkSession
    splits = df.rdd.getNumPartitions()
    size = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(-(-splits * size // TASK_BYTES), 4 * spark.sparkContext.defaultParallelism)
    return df.coalesce(tasks) if tasks < splits else df


def split_row() -> Column:
    """Number of a row in the task that scans it; rows of one split ascend."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def split_order(row: Column) -> Column:
    """Exact order of rows read from splittable text files, as DECIMAL(38,0).

    File number, start of the split and :func:`split_row`, from high to low.
    A decimal is a fixed-width aggregation buffer, which a struct is not.
    """
    def number(value: Column, digits: int) -> Column:
        return value.cast(T.DecimalType(digits, 0))

    per_file = F.lit(Decimal(1 << 73)).cast(T.DecimalType(23, 0))
    per_split = F.lit(Decimal(1 << 33)).cast(T.DecimalType(10, 0))
    place = (
        number(F.col("file_no"), 10) * per_file
        + number(F.col("file_block_start"), 19) * per_split
        + number(row, 10)
    )
    return place.cast(T.DecimalType(38, 0))
