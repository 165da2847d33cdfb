"""Hard negatives of anchor vectors: exact integer scores, tile by tile.

Vectors become integers once and are written with a number for each row. Anchors
are taken in blocks of at most about ``ANCHORS_AT_ONCE``, which are broadcast (8 MB
at 64 components). Against each block all rows are read twice, in tiles: the
scores of an anchor tile and a candidate tile are one integer matrix product
(``strassen``). The first pass fills a heap of the best rows of the same label for
each anchor; the second, one heap for each anchor and positive with the best rows
of other labels whose scores lie in the positive's window. A task's heaps are
merged with those of the other tasks by rank, which Spark cuts down before and
after the shuffle. Nothing grows with the number of rows but the reading.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part; scaled components beyond ``LIMIT`` count as it, so that
every score fits 64 bits; vectors of different lengths are compared as if padded
with zeros; a null id comes last among ties and is no anchor; rows of one id are
rows of their own, also as anchors; an anchor without positives, or a positive
with an empty window, gives no rows, and so does an empty table. Extra columns are
ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anualia.llm.strassen import multiply
from anualia.scratch import materialize, new_path

ANCHORS_AT_ONCE = 1 << 14
TILE = 1 << 10
LIMIT = 1 << 28  # of a scaled component
NO_ID = (1 << 63) - 1  # stands for a null id, which comes last
_LOWEST = -(1 << 63)


def as_integers(vector: Column, scale: int) -> Column:
    """Every component times ``scale``, rounded down."""
    def scaled(x: Column) -> Column:
        return F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")

    return F.transform(vector, scaled)


def usable(vector: Column, label: Column) -> Column:
    """Label and vector are there, and every component is a finite number."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return label.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix; shorter lists end with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


class Heaps:
    """For each slot its ``size`` best entries: higher scores first, ties by smaller id, then row."""

    def __init__(self, slots: int, size: int):
        self.score = np.full((slots, size), _LOWEST)
        self.id = np.full((slots, size), NO_ID)
        self.row = np.full((slots, size), -1)

    def worth(self, slots: np.ndarray) -> np.ndarray:
        """The least score that may still enter each of the slots."""
        return self.score[slots, -1]

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """Merge entries into their slots."""
        some = np.unique(slot)
        held = self.row[some] >= 0
        slot = np.concatenate([np.repeat(some, held.sum(1)), slot])
        score = np.concatenate([self.score[some][held], score])
        ids = np.concatenate([self.id[some][held], ids])
        row = np.concatenate([self.row[some][held], row])
        order = np.lexsort((row, ids, ~score, slot))  # ~score falls as the score rises, without overflow
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.score.shape[1]
        to, order = (slot[kept], place[kept]), order[kept]
        self.score[to], self.id[to], self.row[to] = score[order], ids[order], row[order]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slot, score, id and row of all entries."""
        slot, place = np.nonzero(self.row >= 0)
        return slot, self.score[slot, place], self.id[slot, place], self.row[slot, place]


def _tiles(batches: Iterator[pa.RecordBatch], anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First anchor, scores, and the candidates' rows, ids and labels, for each anchor tile and candidate tile."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            row, ids, label = (part.column(i).to_numpy() for i in range(3))
            across = np.ascontiguousarray(matrix(part.column(3)).T)
            for first in range(0, len(anchors), TILE):
                yield first, multiply(anchors[first : first + TILE], across), row, ids, label


def _entry_batch(heaps: Heaps) -> pa.RecordBatch:
    slot, score, ids, row = heaps.entries()
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (slot, score, ids, row)], names=["slot", "score", "id", "row"])


def _best(entries: DataFrame, size: int) -> DataFrame:
    """The tasks' heaps merged: each slot's best entries with their rank."""
    order = W.partitionBy("slot").orderBy(F.desc("score"), "id", "row")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


_ENTRY = "slot long, score long, id long, row long"


def _positives(table: DataFrame, block: dict[str, np.ndarray], size: int) -> pa.Table:
    """The best rows of each anchor's own label: slot (number of the anchor), rank, score, id."""
    shared = table.sparkSession.sparkContext.broadcast(block)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        heaps = Heaps(len(own["row"]), size)
        for first, scores, row, ids, label in _tiles(batches, own["vectors"]):
            some = slice(first, first + len(scores))
            alike = own["label"][some, None] == label
            alike &= own["row"][some, None] != row
            alike &= scores >= heaps.worth(np.arange(first, first + len(scores)))[:, None]
            a, c = np.nonzero(alike)
            if len(a):
                heaps.offer(a + first, scores[a, c], ids[c], row[c])
        yield _entry_batch(heaps)

    return _best(table.mapInArrow(found, _ENTRY), size).toArrow()


def _window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest x with low * score <= 100 * x <= high * score; no product leaves 64 bits."""
    whole, rest = np.divmod(score, 100)
    return whole * low - (-rest * low) // 100, whole * high + rest * high // 100


def _negatives(table: DataFrame, block: dict[str, np.ndarray], chosen: dict[str, np.ndarray], size: int, low: int, high: int) -> DataFrame:
    """The best rows of other labels in the window of each anchor and positive."""
    shared = table.sparkSession.sparkContext.broadcast((block, chosen))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = shared.value
        heaps = Heaps(len(pairs["anchor"]), size)
        least, most = _window(pairs["score"], low, high)
        # Pairs are in the order of their anchors; the pairs of one tile are a run of them.
        for first, scores, row, ids, label in _tiles(batches, own["vectors"]):
            a, b = np.searchsorted(pairs["anchor"], [first, first + len(scores)])
            other = own["label"][first : first + len(scores), None] != label
            for at in range(a, b, TILE):
                slots = np.arange(at, min(at + TILE, b))
                of = pairs["anchor"][slots] - first
                part = scores[of]
                fits = other[of]
                fits &= part >= np.maximum(least[slots], heaps.worth(slots))[:, None]
                fits &= part <= most[slots, None]
                p, c = np.nonzero(fits)
                if len(p):
                    heaps.offer(slots[p], part[p, c], ids[c], row[c])
        yield _entry_batch(heaps)

    return _best(table.mapInArrow(found, _ENTRY), size)


def mine(
    vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the hard negatives.

    ``anchor`` is a condition on the columns of ``vectors``. A negative's score
    lies between ``low`` and ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vector_col), F.col(label_col)))
    table = materialize(
        kept.select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
            F.col(label_col).cast("long").alias("label"),
            as_integers(F.col(vector_col), scale).alias("vector"),
            F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("is_anchor"),
        ),
        "vectors",
    )
    candidates = table.select("row", "id", "label", "vector")
    anchors = table.where("is_anchor").select("row", "id", "label", "vector")
    blocks = max(1, -(-anchors.count() // ANCHORS_AT_ONCE))
    out = new_path(spark, "negatives")
    for number in range(blocks):
        some = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).orderBy("row").toArrow()
        block = {n: some[n].to_numpy() for n in ("row", "id", "label")} | {"vectors": matrix(some["vector"])}
        best = _positives(candidates, block, positives)
        slot, rank = best["slot"].to_numpy(), best["rank"].to_numpy()
        order = np.lexsort((rank, slot))
        chosen = {"anchor": slot[order], "score": best["score"].to_numpy()[order], "id": best["id"].to_numpy()[order]}
        pairs = spark.createDataFrame(
            pa.table({
                "slot": pa.array(np.arange(len(order))), "anchor_id": pa.array(block["id"][chosen["anchor"]]),
                "positive_id": pa.array(chosen["id"]), "positive_score": pa.array(chosen["score"]),
            }),
            "slot long, anchor_id long, positive_id long, positive_score long",
        )
        found = _negatives(candidates, block, chosen, negatives, low, high)
        # At most ``positives`` rows for each anchor of the block.
        found.join(F.broadcast(pairs), "slot").select(
            "anchor_id", _id("positive_id"), "rank", _id("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.parquet(f"{out}/block={number}")
    return spark.read.parquet(out).drop("block")


def _id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)
