"""Report bundle: named sheets written together and seen together.

Every run writes its sheets into a folder of its own. When all are there, one small
manifest is written that names them. A reader goes by the latest manifest, so it
sees all sheets of one run or none, and a run that was ended in between leaves what
was there before. A rerun writes new folders and a later manifest.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version long, run string, format string, sheets array<struct<name: string, schema: string>>"


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, for formats without nested types."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({
        a: F.concat_ws(", ", F.col("`" + a + "`").cast("array<string>")) for a in arrays
    })


def write_bundle(path: str, sheets: dict[str, DataFrame], fmt: str = "parquet") -> str:
    """Write every sheet in parallel part files, then the manifest; returns the run's id."""
    if not sheets:
        raise ValueError("a bundle needs a sheet")
    root, run = path.rstrip("/"), uuid.uuid4().hex
    written = []
    for name, df in sheets.items():
        sheet = flat(df) if fmt == "csv" else df
        writer = sheet.write.option("header", True) if fmt == "csv" else sheet.write
        writer.format(fmt).save(f"{root}/runs/{run}/{name}")
        written.append((name, sheet.schema.json()))
    version = time.time_ns()
    spark = next(iter(sheets.values())).sparkSession
    # A single row, so that the manifest is one file, which is there whole or not at all.
    manifest = spark.createDataFrame([(version, run, fmt, written)], _MANIFEST).coalesce(1)
    manifest.write.json(f"{root}/manifests/{version:020d}-{run}")
    return run


@dataclass(frozen=True)
class Bundle:
    """The sheets of one run."""

    path: str
    run: str
    format: str
    schemas: dict[str, T.StructType]

    def sheet(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.schemas:
            raise KeyError(f"no sheet {name}; there are {', '.join(self.schemas)}")
        reader = spark.read.schema(self.schemas[name]).option("header", True) if self.format == "csv" else spark.read.schema(self.schemas[name])
        return reader.format(self.format).load(f"{self.path}/runs/{self.run}/{name}")


def open_bundle(spark: SparkSession, path: str) -> Bundle:
    """The latest complete run under a path."""
    root = path.rstrip("/")
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{root}/manifests/*").orderBy(F.desc("version"), F.desc("run")).limit(1).collect()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = []
    if not rows:
        raise FileNotFoundError(f"no complete bundle under {path}")
    (row,) = rows
    return Bundle(root, row["run"], row["format"], {s["name"]: T.StructType.fromJson(json.loads(s["schema"])) for s in row["sheets"]})


def read_sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A sheet of the latest complete run."""
    return open_bundle(spark, path).sheet(spark, name)
