"""Scores of texts under a word-count base and an online context-mixing model.

Learning reads every text of the training part: words are counted, the most
frequent ones become the head of the alphabet (``context_mixing``), and every
yes/no decision of every training text is counted in its hashed contexts. Counts
are kept in arrays while a task runs and meet page by page; a reducer adds them
up as they stream in and holds its pages alone. The arrays grow with the number of
training tokens up to 2^22 places a context; reducers turn them into a byte of log-odds and a byte of
size for each place, at most 25 MB for the driver.
The weights that start the mixing are fitted on every decision of every training
text, by sums over all tasks.

Scoring codes every text whole and gives the sum of its decisions' costs. The
base adds a logarithm for every token. Head words have their counts at hand;
other words go by shuffle to the table of counts, none of which is frequent.

Broadcast: the head (at most ``HEAD_WORDS`` words) and the tables.

Defined results: a null or empty text is one end token; a document with a null
id is learned from; without training texts all counts are zero and every
decision costs one bit; rows of one id are scored each; an empty table gives no
rows. Extra columns are ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anualia.llm import context_mixing as cm
from anualia.llm.common import parts
from anualia.scratch import materialize

FOLDS = 7
HELD_OUT = 2
HEAD_WORDS = 1 << 18
PAGE = 1 << 13
SPELLED_AT_ONCE = 16_000_000  # bytes of texts whose words are looked up in one go
_STEPS_PER_OCTAVE = 16


@dataclass(frozen=True)
class Trained:
    model: cm.Model
    logs: np.ndarray  # log10(count + 1) of each symbol as a token; zero for bytes and word ends
    counts: DataFrame  # word, n
    tokens: int
    distinct: int


def held_out(doc_id: Column) -> Column:
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


# ---- learning ------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, words = cm.split_words(batch.column(0))
        found = words.value_counts()
        yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte and the word end are spelled in words outside the head."""
    total = np.zeros(cm.TEXT_END, np.int64)
    for batch in batches:
        words, n = batch.column(0), batch.column(1).to_numpy()
        letters = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)
        total[: cm.WORD_END] += np.bincount(letters, np.repeat(n, pc.binary_length(words).to_numpy()), cm.WORD_END).astype(np.int64)
        total[cm.WORD_END] += n.sum()
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["symbol", "n"])


def _head(counts: DataFrame) -> tuple[pa.Array, np.ndarray, Column]:
    """The most frequent words, their counts, and the condition on ``n`` that picks them: whole steps of frequency, at most HEAD_WORDS words."""
    step = F.floor(F.log2("n") * _STEPS_PER_OCTAVE)
    words, least = 0, None
    for level, size in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        words += size
        if words > HEAD_WORDS:
            break
        least = level
    if least is None:
        return pa.array([], pa.string()), np.zeros(0, np.int64), F.lit(False)
    chosen = step >= least
    table = counts.where(chosen).orderBy(F.desc("n"), "word").select("word", "n").toArrow().combine_chunks()
    return table["word"].combine_chunks().cast(pa.string()), table["n"].to_numpy(), chosen


def _pack(values: np.ndarray) -> bytes:
    """A page of counts: how many are 255 or more, their places and values, then a byte for each place."""
    large = np.flatnonzero(values >= 255)
    parts = [np.array([len(large)], "<u4"), large.astype("<u4"), values[large].astype("<i8"), np.minimum(values, 255).astype(np.uint8)]
    return b"".join(p.tobytes() for p in parts)


def _add(sums: np.ndarray, blob: bytes) -> None:
    """Add a packed page."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    large = np.frombuffer(blob, "<u4", n, 4)
    sums += np.frombuffer(blob, np.uint8, PAGE, 4 + 12 * n)
    sums[large] += np.frombuffer(blob, "<i8", n, 4 + 4 * n) - 255


def _pages(pages: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pages, pa.int32()), pa.array(blobs, pa.binary())], names=["page", "cells"])


def _sum_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log-odds and sizes of the places of each page, after the tasks' counts were added as they streamed in."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _add(sums.setdefault(page, np.zeros(PAGE, np.int64)), blob)
    for page, values in sums.items():
        yield _pages([page], [cm.stretched(values).tobytes() + cm.sizes(values).tobytes()])


def _spelled(alphabet: cm.Alphabet, batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, cm.Spelled]]:
    """The batches in parts, each with its symbols."""
    for batch in batches:
        for large in parts(batch, column, SPELLED_AT_ONCE):
            several = list(parts(large, column))
            yield from zip(several, alphabet.spell_each(part.column(column) for part in several))


def _count_decisions(texts: DataFrame, alphabet: cm.Alphabet, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of 2 ** bits places for each context: log-odds and sizes of the counts of all decisions of all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(alphabet)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        cells = cm.count(known, (spelled for _, spelled in _spelled(known, batches, 0)), bits)
        for page, values in enumerate(cells.reshape(-1, PAGE)):
            if values.any():
                yield _pages([page], [_pack(values)])

    found = texts.mapInArrow(counted, "page int, cells binary").repartition("page").mapInArrow(_sum_pages, "page int, cells binary")
    # Two bytes for each place; an untouched page has log-odds and sizes of zero.
    tables, half = np.zeros((2, cm.ORDERS << bits), np.int8), PAGE // 2
    for page, blob in found.toLocalIterator(prefetchPartitions=True):
        tables[:, page * half : (page + 1) * half] = np.frombuffer(bytes(blob), np.int8).reshape(2, half)
    return tables[0].reshape(cm.ORDERS, -1), tables[1].reshape(cm.ORDERS, -1)


def _node_odds(alphabet: cm.Alphabet, weights: np.ndarray) -> np.ndarray:
    """Log-odds of a one at each node, from the symbols' counts."""
    of = np.repeat(weights.astype(float), alphabet.length)
    size = int(alphabet.nodes.max()) + 1
    ones = np.bincount(alphabet.nodes, of * alphabet.bits, size)
    total = np.bincount(alphabet.nodes, of, size)
    return np.log((ones + cm.PRIOR) / (total - ones + cm.PRIOR)).astype(np.float32)


def _start_weights(texts: DataFrame, alphabet: cm.Alphabet, odds: np.ndarray, tables: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Gate weights fitted on all decisions of all texts."""
    both = tables.view(np.uint8).astype(np.uint16) << 8 | seen.view(np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast((alphabet, odds, both))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *learned = shared.value
        found = cm.weight_sums(known, *learned, (spelled for _, spelled in _spelled(known, batches, 0))).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int32()), pa.array(found)], names=["place", "value"])

    # Added up in whole millionths, which come to the same sum in any order.
    exact = F.round(F.col("value") * 1_000_000).cast("decimal(38,0)")
    rows = texts.mapInArrow(summed, "place int, value double").groupBy("place").agg(F.sum(exact).alias("total")).collect()
    sums = np.zeros((cm.DEPTHS * 2, cm.ORDERS + 3, cm.ORDERS + 2))
    for place, total in rows:
        sums.reshape(-1)[place] = float(total) / 1_000_000
    return cm.fit_weights(sums)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trained:
    """Counts, alphabet, tables and weights from the documents outside the held-out fold."""
    texts = docs.where(~held_out(F.col(id_col))).select(F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counted, "lm-words")
    documents = texts.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    head, often, chosen = _head(counts)
    weights = np.zeros(cm.FIRST_WORD + len(head), np.int64)
    spelled = counts.where(~chosen).mapInArrow(_count_bytes, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    for symbol, n in spelled.collect():
        weights[symbol] = n
    weights[cm.TEXT_END] = documents
    weights[cm.FIRST_WORD :] = often
    alphabet = cm.Alphabet.build(head, weights)
    odds = _node_odds(alphabet, weights)

    tokens = int(words) + documents
    tables, seen = _count_decisions(texts, alphabet, cm.table_bits(tokens))
    mixed = _start_weights(texts, alphabet, odds, tables, seen)
    logs = np.log10(weights + 1.0)
    logs[: cm.TEXT_END] = 0.0
    model = cm.Model(alphabet, odds, tables, mixed)
    return Trained(model, logs, counts, tokens, int(distinct) + (documents > 0))


# ---- scoring -------------------------------------------------------------------

def _by_length(batch: pa.RecordBatch, column: int) -> pa.RecordBatch:
    """The batch with its texts by length, so that texts coded side by side end at about the same block."""
    return batch.take(pc.array_sort_indices(pc.fill_null(pc.binary_length(batch.column(column)), 0)))


def score(docs: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, base_score, score (log10) and bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast((trained.model, trained.logs))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs = shared.value
        for part, spelled in _spelled(model.alphabet, (_by_length(batch, 3) for batch in batches), 3):
            texts, n = part.column(3), part.num_rows
            bits = model.bits(spelled, n)
            head = np.bincount(spelled.text, spelled.symbols >= cm.FIRST_WORD, n).astype(np.int64)
            others = np.bincount(spelled.rest_text, minlength=n)
            base = np.bincount(spelled.text, logs[spelled.symbols], n)
            size = np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1)
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, others.cumsum()), pa.int32()), spelled.rest)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), part.column(2), pa.array(head + others + 1),
                    pa.array(head + int(logs[cm.TEXT_END] > 0)), pa.array(base), pa.array(bits), pa.array(bits / size), rest,
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "bits", "bits_per_byte", "rest"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    done = materialize(
        rows.mapInArrow(
            scored,
            f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, bits double, bits_per_byte double, "
            "rest array<string>",
        ),
        "lm-rows",
    )
    # Words outside the head: their counts by shuffle, then one sum for each row.
    asked = done.select("row", F.explode("rest").alias("word"))
    found = asked.join(trained.counts.hint("merge"), "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more"), F.count("n").alias("more_known")
    )
    unit = float(np.log10(trained.tokens + trained.distinct + 1.0))
    return done.drop("rest").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(trained.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("bits") * -float(np.log10(2.0))).alias("score"),
        "bits_per_byte",
    )
