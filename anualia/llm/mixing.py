"""Mixing sources to target weights with hash-threshold histograms.

The size of a document is its number of words. Sources in code point order (null
last) get the given weights in turn and share the words of the whole corpus; no
target exceeds ``cap`` times its source, and what is cut off goes to the other
sources by weight until none is above.

A source is taken whole ``floor(target / size)`` times. The rest of its budget
is met by a threshold on a hash of the document: words are summed by source and
hash bucket, the running sum over the buckets shows in which bucket the budget
ends, and only that bucket is refined by the next bits of the hash. The
thresholds of the repeats are nested, all but one of them take everything. One
filter then applies the threshold; nothing is sorted and no document leaves its
partition.

Defined results: a null or blank text has size 0 and its source counts as any
other; a null source is a source; rows with equal id and text have one hash and
are taken together; the last unit at a threshold is taken when that ends nearer
to the budget; an empty table gives no rows. Extra columns are carried untouched
by ``take`` whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anualia.llm.common import broadcast_if_small, split_words
from anualia.operators.sequence import number_rows
from anualia.scratch import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
HASH_BITS = 60
LEVEL_BITS = 12  # buckets of one histogram: 4096 for each source


def place(doc_id: Column, text: Column) -> Column:
    """A document's place in its source: 60 bits of a hash of id and text."""
    digest = F.md5(F.concat_ws("/", doc_id.cast("string"), text))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, source, size in words and hash place of every document."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.size(split_words(F.col(text_col))).cast("long").alias("size"),
        place(F.col(id_col), F.col(text_col)).alias("place"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Source, source_size and target; every round of sharing is one aggregate over the sources."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    keys = [F.col("source").isNull(), F.col("source")]
    turn = F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int")
    weighted = number_rows(per_source, keys, "number").select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"),
    )
    weighted = materialize(weighted, "mix-sources")
    limit = F.col("source_size") * float(cap)
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, closed = -1.0, -1
    while True:
        # Sources whose share at the last level reached their limit stay closed: the level only rises.
        full = F.col("weight") * level >= limit
        capped, open_weight, n_closed = weighted.agg(
            F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if n_closed == closed or not open_weight:
            break
        closed, level = n_closed, (float(total) - (capped or 0.0)) / open_weight
    return weighted.select("source", "source_size", F.least(limit, F.col("weight") * max(level, 0.0)).alias("target"))


def thresholds(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """Per source: repeats taken whole, and ``last``, the greatest hash place of the part taken once more.

    Each level reads only documents in the boundary bucket of the level above.
    """
    budget = F.col("target") - F.col("whole") * F.col("source_size")
    plan = shares.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    ).withColumn("budget", budget)
    # State of a source: words below the open bucket, and the bucket by its first place; all of the hash at first.
    state = materialize(plan.select("source", "budget", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("first")), "mix-state")
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        width = 1 << shift
        opened = broadcast_if_small(state.withColumnRenamed("source", "key"))
        inside = sized.join(opened, F.col("source").eqNullSafe(F.col("key"))).where(
            F.col("place").between(F.col("first"), F.col("first") + ((width << LEVEL_BITS) - 1))
        )
        bucket = F.shiftright("place", shift)
        histogram = inside.groupBy("source", "budget", "below", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("place").alias("low"), F.max("place").alias("high")
        )
        running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        before = F.col("below") + F.coalesce(F.sum("words").over(running), F.lit(0))
        # The boundary bucket is the last one whose first word is still within the budget.
        state = materialize(
            histogram.withColumn("before", before)
            .where(F.col("before") < F.col("budget"))
            .groupBy("source", "budget")
            .agg(F.max(F.struct("bucket", "before", "words", "low", "high")).alias("edge"))
            .select(
                "source", "budget", F.col("edge.before").alias("below"),
                F.shiftleft("edge.bucket", shift).alias("first"),
                F.col("edge.words").alias("words"), F.col("edge.low").alias("low"), F.col("edge.high").alias("high"),
            ),
            "mix-state",
        )
        if not state.where(F.col("low") < F.col("high")).limit(1).count():
            break
        state = state.select("source", "budget", "below", "first")
    # One unit is left: taken if the sum then ends nearer to the budget, a tie included.
    nearer = F.col("below") * 2 + F.col("words") <= F.col("budget") * 2
    edge = state.select(F.col("source").alias("key"), F.when(nearer, F.col("high")).otherwise(F.col("low") - 1).alias("last"))
    return (
        plan.join(edge, F.col("source").eqNullSafe(F.col("key")), "left")
        .select("source", "source_size", "target", F.col("whole").cast("long").alias("whole"), F.coalesce("last", F.lit(-1)).alias("last"))
    )


def repeats(whole: Column, last: Column, doc_place: Column) -> Column:
    """How often a document is taken."""
    return whole + F.when(doc_place <= last, F.lit(1)).otherwise(F.lit(0))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Sizes of the documents, and the targets and thresholds of the sources."""
    sized = materialize(sizes(docs, **columns), "mix-sizes")
    return sized, materialize(thresholds(sized, targets(sized, weights, cap)), "mix-plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, **columns: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, repeats and taken words."""
    sized, plan = plan_mix(docs, weights, cap, **columns)
    sources = broadcast_if_small(plan.withColumnRenamed("source", "key"))
    times = repeats(F.col("whole"), F.col("last"), F.col("place"))
    return sized.join(sources, F.col("source").eqNullSafe(F.col("key"))).select(
        "doc_id", "source", "size", "source_size", "target",
        times.alias("repeats"), (times * F.col("size")).alias("taken"),
    )


def take(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns it came with."""
    _, plan = plan_mix(docs, weights, cap, id_col=id_col, text_col=text_col, source_col=source_col)
    sources = broadcast_if_small(plan.select(F.col("source").alias("key"), "whole", "last"))
    placed = docs.select(
        F.struct("*").alias("doc"), F.col(source_col).alias("source"), place(F.col(id_col), F.col(text_col)).alias("place")
    )
    times = repeats(F.col("whole"), F.col("last"), F.col("place")).cast("int")
    return (
        placed.join(sources, F.col("source").eqNullSafe(F.col("key")))
        .select("doc", F.explode(F.array_repeat(F.lit(0), times)).alias("copy"))
        .select("doc.*")
    )
