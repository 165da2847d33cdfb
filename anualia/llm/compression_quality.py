"""Quality score from compressed sizes under two zstandard dictionaries.

One dictionary is built from texts labelled good, one from texts labelled bad. A
text is cut into chunks of equal size, all chunks are compressed with both, and
the difference of the two sizes per byte says which side the text resembles. A
logistic curve over that difference and over the size per byte under the good
dictionary turns it into a probability; it is fitted on labelled texts that had
no part in the dictionaries.

Bound of the fit: some ``SAMPLE_ROWS`` labelled documents of each class, picked by
a hash. One half of them gives the dictionaries, which hold 64 KB and see
``FRAGMENT`` bytes of each document, from a place that depends on the id. The other
half is measured in tasks, whole text by whole text as in scoring, and the curve is
fitted on these measures, weighted by the class shares of all labels.

Defined results: null and empty texts score as a text without any difference;
labels that are null or contradict each other equally are not learned from; a
document without an id is scored and never learned from; without labels of both
classes every score is the share of good labels (0.5 if there is none). Equal
texts get equal scores. Extra columns are ignored by ``score`` and carried by
``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anualia.llm.common import broadcast_if_small
from anualia.scratch import materialize

FOLDS = 3
HELD_OUT = 1
SAMPLE_ROWS = 4_000
PLACES = 1 << 31  # of the hash that picks the sample
FRAGMENT = 4_096
DICTIONARY = 65_536
CHUNK = 2_048
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the logistic curve as bias and two factors."""

    good: bytes
    bad: bytes
    curve: tuple[float, float, float]


class Compressors:
    """The model's compressors; made once in each task."""

    def __init__(self, model: Model):
        self._curve = model.curve
        self._pair = [self._make(d) for d in (model.good, model.bad)] if model.good and model.bad else None

    @staticmethod
    def _make(dictionary: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)

    def features(self, text: bytes) -> tuple[float, float]:
        """Size difference per byte, and size per byte under the good dictionary."""
        if not text or self._pair is None:
            return 0.0, 0.0
        good, bad = self._pair
        view = memoryview(text)
        chunks = [view[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        in_good = sum(len(good.compress(c)) for c in chunks)
        in_bad = sum(len(bad.compress(c)) for c in chunks)
        return (in_bad - in_good) / len(text), in_good / len(text)

    def score(self, text: bytes) -> float:
        bias, by_difference, by_rate = self._curve
        difference, rate = self.features(text)
        z = bias + by_difference * difference + by_rate * rate
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0))))


def fold(doc_id: Column) -> Column:
    """Remainder that decides on the held-out part; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> tuple[DataFrame, float]:
    """The sample: doc_id, label, half, place and the bytes of the whole text; and the share of good ones among all labels."""
    votes = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    votes = votes.groupBy(F.col("doc_id").alias("key")).agg(F.avg("quality").alias("share")).where(F.col("share") != 0.5)
    votes = votes.select("key", (F.col("share") > 0.5).cast("int").alias("label"))
    # Labels without a text would leave gaps, so labels are matched before the sample is drawn.
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("bytes"))
    half = F.pmod(F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string")).cast("binary")), F.lit(2))
    found = texts.join(broadcast_if_small(votes), F.col("doc_id") == F.col("key")).select(
        "doc_id", "label", half.alias("half"), F.pmod(F.xxhash64("doc_id", "bytes"), F.lit(PLACES)).alias("place"), "bytes"
    )
    # Rows of one id may be many; the text is in the hash too, so only equal rows share a place.
    below = F.lit(0)
    for r in found.groupBy("label", "half").count().collect():
        share = min(1.0, 1.2 * (rows // 2) / r["count"])
        below = F.when((F.col("label") == r["label"]) & (F.col("half") == r["half"]), int(share * PLACES)).otherwise(below)
    share = votes.agg(F.avg("label")).first()[0]
    return found.where(F.col("place") < below), 0.5 if share is None else share


def _least(sample: DataFrame, rows: int) -> list:
    """At most half of ``rows`` of each label, those with the least places."""
    order = ["place", *(c for c in sample.columns if c not in ("place", "label"))]
    parts = [sample.where(F.col("label") == v).orderBy(*order).limit(rows // 2) for v in (1, 0)]
    return [r for part in parts for r in part.collect()]


def _fragments(sample: DataFrame, rows: int) -> dict[int, list[bytes]]:
    """Pieces of the texts that the dictionaries are built from, by label."""
    span = F.greatest(F.octet_length("bytes") - FRAGMENT + 1, F.lit(1))
    cut = F.substring(F.col("bytes"), F.pmod(F.xxhash64("doc_id"), span).cast("int") + 1, F.lit(FRAGMENT))
    found = _least(sample.where("half = 0").select("label", "place", "doc_id", cut.alias("bytes")), rows)
    return {v: [bytes(r["bytes"]) for r in found if r["label"] == v and r["bytes"]] for v in (1, 0)}


def _measures(sample: DataFrame, model: Model, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of whole texts of the other half, and their labels."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Compressors(shared.value)
        for batch in batches:
            found = np.array([pair.features(t.as_py()) for t in batch.column(2)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["label", "place", "difference", "rate"]
            )

    texts = sample.where("half = 1").select("label", "place", "bytes")
    # Written once: both labels are read from it.
    table = materialize(texts.mapInArrow(measured, "label int, place long, difference double, rate double"), "quality-measures")
    found = _least(table, rows)
    points = np.array([(r["difference"], r["rate"]) for r in found]).reshape(-1, 2)
    return points, np.array([r["label"] for r in found], dtype=float)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY:].ljust(8, b" ")


def _logistic(points: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float, float]:
    """Newton's method on scaled features with a little ridge; classes weigh as ``share`` says."""
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    mean, spread = points.mean(0), points.std(0) + 1e-9
    x = np.c_[np.ones(len(points)), (points - mean) / spread]
    w = np.zeros(3)
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w += np.linalg.solve(hessian, x.T @ (weight * (labels - p)) - 1e-2 * w)
    factors = w[1:] / spread
    return float(w[0] - factors @ mean), float(factors[0]), float(factors[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Dictionaries from one half of the sample, the curve from the other half."""
    sample, share = _labelled(docs, labels, id_col, text_col, rows)
    pieces = _fragments(sample, rows)
    if pieces[0] and pieces[1]:
        raw = Model(_dictionary(pieces[1]), _dictionary(pieces[0]), (0.0, 0.0, 0.0))
        points, kinds = _measures(sample, raw, rows)
        if len(set(kinds.tolist())) == 2:
            return Model(raw.good, raw.bad, _logistic(points, kinds, share))
    odds = float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share == 1 else -30.0)
    return Model(b"", b"", (odds, 0.0, 0.0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Compressors(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values = [pair.score(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least one half, as they came. The text decides, not the id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Compressors(shared.value)
        at = names.index(text_col)
        for batch in batches:
            good = [pair.score((t or "").encode()) >= 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
