"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so the question is containment: which
share of an item's shingles a document holds. Items are partitioned by size into
classes whose bounds are powers of two. Of each item the shingles with the least
hashes form its MinHash sample; the sample size belongs to the class and is one
more than the shingles that the largest item of the class may miss. So a
document that holds the required share of an item holds at least one shingle of
its sample: the search loses nothing, and it looks up a few shingles of an item
instead of all. Documents that hit enough of a sample are candidates, and each
candidate is verified by the exact containment of the shingle texts.

A text is lower-cased and split at everything but letters, marks and digits.
Shingles have five words; an item of one to four words is one shingle of its own
length.

Defined results: null and blank texts and items match nothing; a null id is
reported as null; rows of one id are searched apart and reported once with the
highest containment; repeated items are found each; an empty table on either
side gives no rows. Extra columns are ignored, whatever their names are.

Samples and items are broadcast up to a bound in rows, items in bytes too. Beyond it
they are joined by a shuffle in which the documents of one hash or item are dealt to
several tasks, so that a phrase or an item in a third of all documents fills none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anualia.llm.common import broadcast_if_small, join_small
from anualia.scratch import materialize

SHINGLE = 5
THRESHOLD = 0.8
_GAP = r"[^\p{L}\p{M}\p{N}]+"


def normal_words(text: Column) -> Column:
    """Lower-case words of letters, marks and digits."""
    cleaned = F.btrim(F.regexp_replace(F.lower(text), _GAP, " "))
    return F.when(F.length(cleaned) > 0, F.split(cleaned, " ")).otherwise(F.array().cast("array<string>"))


def _runs(words: Column, length: int, make) -> Column:
    """A value for each run of ``length`` words; none if the text is shorter."""
    starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
    runs = F.transform(starts, lambda i: make(F.slice(words, i, F.lit(length))))
    return F.when(F.size(words) >= length, runs)


def _joined(run: Column) -> Column:
    return F.array_join(run, " ")


def _shingles(words: Column, lengths: list[int], make) -> Column:
    """Distinct shingles of all the lengths."""
    parts = [F.coalesce(_runs(words, n, make), F.array()) for n in lengths]
    return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Item rows with their shingle length and distinct shingles."""
    words = benchmark.select(F.col(item_col).alias("item_id"), normal_words(F.col(text_col)).alias("words"))
    words = words.where(F.size("words") > 0).select("item_id", "words", F.least(F.lit(SHINGLE), F.size("words")).alias("length"))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    texts = F.array_distinct(F.transform(starts, lambda i: _joined(F.slice("words", i, F.col("length")))))
    rows = words.select("item_id", "length", texts.alias("shingles")).withColumn("size", F.size("shingles"))
    return materialize(rows.withColumn("item", F.monotonically_increasing_id()), "bench-items")


def samples_of(items: DataFrame, threshold: float) -> DataFrame:
    """MinHash samples: the shingles of least hash, as many as the item's size class asks for.

    ``needed`` is how many of them a document holds at least if it holds the item.
    """
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("size").cast("double"))) + 1) - 1
    missing = lambda size: F.floor(F.round(size * (1 - threshold), 6))
    hashed = items.select(
        "item", "size", (missing(largest) + 1).alias("sample"), F.explode("shingles").alias("shingle")
    ).select("item", "size", "sample", F.xxhash64(F.split("shingle", " ")).alias("hash"))
    rank = F.row_number().over(W.partitionBy("item").orderBy("hash"))
    kept = hashed.withColumn("rank", rank).where(F.col("rank") <= F.col("sample"))
    needed = F.least("sample", "size") - missing(F.col("size"))
    return kept.select("item", "hash", needed.alias("needed"))


def matches(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, size (distinct shingles of the item), found (those in the document) and containment."""
    items = items_of(benchmark, item_col, item_text_col)
    lengths = sorted(r[0] for r in items.select("length").distinct().collect()) or [SHINGLE]  # five values at most
    samples = materialize(samples_of(items, threshold), "bench-samples")

    words = docs.select(F.col(id_col).alias("doc_id"), normal_words(F.col(text_col)).alias("words"))
    hashed = words.select("doc_id", F.explode(_shingles(F.col("words"), lengths, F.xxhash64)).alias("hash"))
    # A phrase that many documents share is a hot hash; map-side where the samples fit, else dealt by document.
    hits = join_small(hashed, samples, "hash", F.col("doc_id")).groupBy("doc_id", "item").agg(
        F.count("*").alias("hits"), F.min("needed").alias("needed")
    )
    pairs = materialize(hits.where(F.col("hits") >= F.col("needed")).select(F.col("doc_id").alias("key"), "item"), "bench-pairs")

    # Exact containment of the shingle texts, for the candidates only.
    wanted = broadcast_if_small(pairs.select("key").distinct())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("key")), "left_semi")
    # Words are a column of their own: inside a lambda an expression would be computed for every shingle.
    shingled = texts.select("doc_id", normal_words(F.col("text")).alias("words"))
    shingled = shingled.select("doc_id", _shingles(F.col("words"), lengths, _joined).alias("held"))
    found = F.size(F.array_intersect("held", "shingles"))
    candidates = shingled.join(broadcast_if_small(pairs), F.col("doc_id").eqNullSafe(F.col("key"))).drop("key")
    item_bytes = F.octet_length(F.array_join("shingles", " "))
    return (
        join_small(candidates, items.select("item", "item_id", "size", "shingles"), "item", F.col("doc_id"), item_bytes)
        .select("doc_id", "item_id", F.col("size").cast("long").alias("size"), found.cast("long").alias("found"))
        .where(F.col("found") >= F.ceil(F.round(F.col("size") * threshold, 6)))
        .groupBy("doc_id", "item_id", "size").agg(F.max("found").alias("found"))
        .withColumn("containment", F.col("found") / F.col("size"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that hold no test item. The text decides, so null and repeated ids do no harm."""
    keyed = docs.select(F.md5(F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    found = matches(keyed, benchmark, threshold).select(F.col("doc_id").alias("key")).distinct()
    found = broadcast_if_small(materialize(found, "bench-found"))
    kept = docs.select(F.struct("*").alias("doc"), F.md5(F.col(text_col)).alias("digest"))
    return kept.join(found, F.col("digest") == F.col("key"), "left_anti").select("doc.*")
