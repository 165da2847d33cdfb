"""From raw documents to token ids: quality, near-duplicates, test items, mix, ids.

Every stage reads the whole table its predecessor wrote and its decision takes
effect: rejected documents go, one document of each near-duplicate group stays,
documents that hold a test item go, documents are taken as often as the mix asks
for, and the rest is written as token ids. All but the last return the columns of
documents. Ids and texts may be null or repeat; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from anualia.llm import compression_quality, decontaminate, mixing, near_duplicates, token_output
from anualia.llm.common import table
from anualia.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at least one half."""
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    return compression_quality.keep_good(docs, model)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash group."""
    return near_duplicates.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids in the written files."""
    return token_output.read_documents(spark, token_output.write_ids(docs, TOKENIZER, END_ID))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token ids", token_ids),
]

ORACLE_SQL = None  # zstandard and the tokenizer are not in SQL; tests hold it against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from the table that the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
