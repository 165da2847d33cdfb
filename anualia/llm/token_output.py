"""Token ids in document order as files of directly addressable codes.

Documents are range-sorted by id, so the ids of the corpus form one long
sequence. Each task cuts its range into segments of whole documents; a segment
is one row of the written Parquet table: the blob with the codes, and for each
document its id and its first place in the segment. Spark's writer commits the
files, so lost executors leave no partial output and any store that Spark
reaches will do. A segment's first place in the corpus is the number of ids in
the segments before it.

Words repeat, so each batch of texts encodes a word once. That is exact for the
tokenizers that compose and lower-case, drop white space and part letters and
digits from signs, as ``_BY_WORD`` says; with any other one whole texts are encoded.

Defined results: a null or empty text has only the end id; null document ids
come first; rows with one id keep the order they are stored in; an empty table
is a table without segments. Extra columns are ignored, whatever their names are.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anualia.llm.addressable import Reader, encode
from anualia.llm.common import broadcast_if_small
from anualia.llm.context_mixing import split_words
from anualia.scratch import new_path

WORDS_AT_ONCE = 500_000  # words whose ids are put together at once
SEGMENT_IDS = 1 << 20  # a segment is closed when it has as many ids

# Normal form and parts of the tokenizers that can be given words one by one.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}

# Printable ASCII signs. A run of them is cut off from letters and digits before it by the tokenizer itself.
_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def _gather(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of the pool that begin there and have those sizes, one after the other."""
    moved = begins - (sizes.cumsum() - sizes)
    return pool.take(np.repeat(moved, sizes) + np.arange(int(sizes.sum())))


class WordEncoder:
    """Ids of many texts at once, from each different word once.

    Words are lower-cased and parted into a stem and the signs after it, which
    leaves far fewer stems than words; words that might hold a special token are
    encoded as they are. Stems of letters alone are encoded many at a time: each
    is one piece to the tokenizer and ends with a word-end id.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._end = end_id
        said = json.loads(Path(path).read_text(encoding="utf-8"))
        special = [t["content"] for t in said["added_tokens"]]
        self._by_word = (
            all(said[k] == v for k, v in _BY_WORD.items()) and said["model"]["end_of_word_suffix"] == "</w>"
            and all(t.startswith("<|") and not any(c.isspace() for c in t) for t in special)
        )
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, sizes) of runs of texts: all their ids, and how many each text has with its end id."""
        if not self._by_word:
            yield from self._encode_whole(texts)
            return
        offsets, words = split_words(texts, lower=False)
        seen = words.dictionary_encode()
        pool, begins, sizes = self._word_ids(seen.dictionary)
        # The end id is one more word, at the end of each text.
        pool, begins, sizes = np.append(pool, np.uint32(self._end)), np.append(begins, len(pool)), np.append(sizes, 1)
        order = np.insert(seen.indices.to_numpy(), offsets[1:], len(begins) - 1)
        stops = offsets[1:] + np.arange(1, len(texts) + 1)
        first = 0
        while first < len(texts):
            done = stops[first - 1] if first else 0
            last = max(int(np.searchsorted(stops, done + WORDS_AT_ONCE)), first + 1)
            some = order[done : stops[last - 1]]
            ids = _gather(pool, begins[some], sizes[some])
            total = np.append(0, sizes[some].cumsum())
            yield ids, np.diff(np.append(0, total[stops[first:last] - done]))
            first = last

    def _encode_whole(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for text in texts.to_pylist():
            found = self._tokenizer.encode(text or "", add_special_tokens=False).ids
            yield np.array([*found, self._end], np.uint32), np.array([len(found) + 1])

    def _ends_plainly(self, stem: str) -> bool:
        """Does the normal form of a stem end with a letter or digit, from which signs are cut off?"""
        plain = self._tokenizer.normalizer.normalize_str(stem)
        return unicodedata.category(plain[-1:] or " ")[0] in "LN"

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool of ids, and for each word where its ids begin and how many they are."""
        low = pc.ascii_lower(words)
        stems = pc.ascii_rtrim(low, characters=_SIGNS)
        special = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        size, kept = (pc.binary_length(a).to_numpy(zero_copy_only=False) for a in (low, stems))
        signed = np.flatnonzero((kept > 0) & (kept < size) & ~special)
        # Signs are cut off after letters and digits, as they are in the normal form.
        tail = low.take(pa.array(signed)).cast(pa.binary()).to_pylist()
        cut = [
            w[k - 1 : k].isalnum() or w[k - 1] >= 0x80 and self._ends_plainly(w[:k].decode())
            for w, k in zip(tail, kept[signed].tolist())
        ]
        parted = np.zeros(len(words), bool)
        parted[signed] = cut
        signs = [w[k:].decode() for w, k, c in zip(tail, kept[signed].tolist(), cut) if c]
        stems = pc.if_else(pa.array(parted), stems, pc.if_else(pa.array(special), words, low)).dictionary_encode()
        signs = pa.array(["", *signs], pa.string()).dictionary_encode()
        second = np.zeros(len(words), np.int64)
        second[parted] = signs.indices.to_numpy()[1:]
        pieces = pa.concat_arrays([stems.dictionary, signs.dictionary])
        pool, begins, sizes = self._piece_ids(pieces)
        both = np.stack([stems.indices.to_numpy(), second + len(stems.dictionary)], 1).reshape(-1)  # stem, signs, stem, signs
        found = _gather(pool, begins[both], sizes[both])
        per_word = sizes[both].reshape(-1, 2).sum(1)
        return found, per_word.cumsum() - per_word, per_word

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alone = pc.utf8_is_alpha(pieces).to_numpy(zero_copy_only=False)
        texts = pieces.to_pylist()
        begins, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        pool, at = [], 0
        letters, others = np.flatnonzero(alone), [np.flatnonzero(~alone)]
        for first in range(0, len(letters), 8192):
            groups = [letters[k : k + 128] for k in range(first, min(first + 8192, len(letters)), 128)]
            joined = [" ".join([texts[i] for i in some.tolist()]) for some in groups]
            for some, found in zip(groups, self._tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(found.ids, np.uint32)
                stops = np.flatnonzero(self._ends_word[ids]) + 1
                if len(stops) != len(some):  # the normal form has signs, or the tokenizer marks no word ends
                    others.append(some)
                    continue
                begins[some], sizes[some] = at + np.append(0, stops[:-1]), np.diff(stops, prepend=0)
                pool.append(ids)
                at += len(ids)
        rest = np.concatenate(others)
        for i, found in zip(rest.tolist(), self._tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            begins[i], sizes[i] = at, len(ids)
            pool.append(ids)
            at += len(ids)
        return np.concatenate([*pool, np.zeros(0, np.uint32)]), begins, sizes


def write_ids(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Write the files; returns their folder."""
    path = path or new_path(docs.sparkSession, "token-ids")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The second key parts rows of one id; ranges are sampled from the keys alone, without the texts.
    ordered = rows.withColumn("row", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    # As many ranges as the documents have parts, so that a range does not grow with the input.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids_type = pa.list_(pa.int64() if kind == "bigint" else pa.string())
    schema = f"part int, segment int, n_ids long, doc_ids array<{kind}>, starts array<long>, codes binary"
    arrow = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", ids_type), ("starts", pa.list_(pa.int64())), ("codes", pa.binary())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, end_id)
        part = TaskContext.get().partitionId()
        segment, names, sizes, held, size = 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            counts = np.concatenate(sizes)
            row = {
                "part": [part], "segment": [segment], "n_ids": [size], "doc_ids": [[n for some in names for n in some]],
                "starts": [counts.cumsum() - counts], "codes": [encode(np.concatenate(held))],
            }
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        for batch in batches:
            known, row = batch.column(0).to_pylist(), 0
            for ids, counts in encoder.encode(batch.column(1)):
                while len(counts):
                    # Whole documents until the segment is full.
                    stops = counts.cumsum()
                    n = min(int(np.searchsorted(stops, SEGMENT_IDS - size)) + 1, len(counts))
                    names.append(known[row : row + n])
                    sizes.append(counts[:n])
                    held.append(ids[: stops[n - 1]])
                    size += int(stops[n - 1])
                    row, ids, counts = row + n, ids[stops[n - 1] :], counts[n:]
                    if size >= SEGMENT_IDS:
                        yield closed()
                        segment, names, sizes, held, size = segment + 1, [], [], [], 0
        if size:
            yield closed()

    ordered.mapInArrow(encoded, schema).write.option("compression", "zstd").parquet(path)
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and crc32 of the ids."""
    table = spark.read.parquet(path)
    sizes = table.select("part", "segment", "n_ids")
    # One row for each task of the writer, then for each segment of one such task.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before_part = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before_part, F.lit(0)).alias("part_start"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("segment").rowsBetween(W.unboundedPreceding, -1))
    places = sizes.select("part", "segment", F.coalesce(inside, F.lit(0)).alias("inside"))
    places = places.join(F.broadcast(parts), "part").select(
        "part", "segment", (F.col("part_start") + F.col("inside")).alias("first")
    )
    rows = table.join(broadcast_if_small(places), ["part", "segment"]).select("first", "n_ids", "doc_ids", "starts", "codes")
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(Reader(row["codes"]).slice(0, row["n_ids"]).astype("<u4").tobytes())
                starts = np.array(row["starts"], np.int64)
                stops = np.append(starts[1:], row["n_ids"])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                        pa.array(starts + row["first"]), pa.array(stops - starts), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return rows.mapInArrow(decoded, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
