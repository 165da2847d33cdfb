"""One query per text operator; each reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anualia.llm import (
    chat_format, compression_quality, decontaminate, hard_negatives, html_extract, language_model, mixing,
    near_duplicates, oracle, periodic_runs, pii, pipeline, rules, token_counts, token_output,
)
from anualia.llm.common import split_words, table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extract(pages, html_extract.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and how many of them the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that it holds."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    return rules.measured(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hash of the base spans of every document, and all spans."""
    return pii.digests(pii.find_spans(table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.byte_vocabulary(VOCABULARY))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    return compression_quality.score(docs, model).select(
        "doc_id", compression_quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and context-mixing score of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.fit(docs))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read from the written files."""
    path = token_output.write_ids(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    return token_output.read_documents(spark, path)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run and digests of every document, one in ten of which is made to repeat itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("n", F.size(split_words(F.col("text"))))
    bent = number.select("doc_id", "text", F.expr("CASE WHEN h % 10 = 0 AND n > 0 THEN (h DIV 10) % n END AS first"), "n", "h").select(
        "doc_id", "text", "first", F.expr("1 + (n - first) DIV (3 + (h DIV 10) % 8) AS period")
    )
    return periodic_runs.digests(periodic_runs.measure(bent, ("doc_id",), "text", ("first", "period")))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from the formatted log of its messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_format.read_conversations(spark, chat_format.write_conversations(chat_format.table_events(rows.unionAll(more))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh row has its label moved on by one."""
    moved = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")
    )
    return hard_negatives.mine(moved, F.col("vec_id") % 100 == 0)


def all_queries() -> dict[str, Query]:
    found = (
        op1_html_extract, op2_mix_sources, op3_decontaminate, op4_quality_rules, op5_personal_data, op6_token_counts,
        op7_near_duplicates, op8_quality_classifier, op9_language_model, op10_token_ids, op11_periodic_runs,
        op12_chat_format, op13_hard_negatives,
    )
    return {f.__name__: f for f in found} | {"pipeline": pipeline.run}


def all_sql() -> dict[str, str]:
    return oracle.all_sql()
