"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint is the bitwise majority of the hashes of its word shingles.
Equal fingerprints are one node, however many documents share it. Anchors are
the words of a covering code with radius R (``covering``). Fingerprints at most
t bits apart have a word between them that differs from either by at most
ceil(t/2) bits, and that word lies within R of its anchor. So each fingerprint
is replicated to the anchors of all words within ceil(t/2) bits of it, which are
anchors within R plus threshold, and a linked pair meets at one of them: nothing
is lost. With t = 2 that is some 20 anchors a fingerprint.

An anchor with one fingerprint needs no work. At a shared anchor the members are
compared through the words of its cell: two members are linked when a word of
the cell lies between them. Such a word has at most V(64, ceil(t/2)) members (65
for t = 2), so no group grows with the data and a cluster of any size makes links
in proportion to its size, not to its square. Links are checked by their bits.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; a text with fewer words than a shingle is one shingle; rows of one id
are separate documents; a null id sorts last and is named as component only if
the whole component has none; an empty table gives no rows. Extra columns are
ignored by ``classes`` and carried by ``keep_one``, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anualia.llm.common import hot_join, join_small
from anualia.llm.components import least_labels
from anualia.llm.covering import Code
from anualia.scratch import materialize

SHINGLE = 3
MAX_BITS = 2
SEED = 42
_BLOCK = 1 << 16  # hashes whose bits are counted at once


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text in UTF-8; A-Z are lower-cased, a bit is set if more than half the hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), "<u8", max(1, len(words) - shingle + 1))
    counts = np.zeros(64, np.int64)
    for first in range(0, hashes.size, _BLOCK):
        block = hashes[first : first + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > hashes.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie (a hash of the text) and node (the fingerprint as a signed long) of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "node"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"doc_id {kind}, tie long, node long")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that connect everything within ``max_bits``.

    For an even threshold all members at a word are linked, and they are given
    as links to the least of them; for an odd one the links are the close pairs.
    """
    reach = (max_bits + 1) // 2

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(reach)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for first in range(0, values.size, 4096):
                some = values[first : first + 4096]
                row, anchor = code.anchors_around(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(some[row].view(np.int64))], names=["anchor", "node"]
                )

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(reach)
        for batch in batches:
            anchors = batch.column(0).to_numpy().view(np.uint64)
            values = batch.column(1).to_numpy().view(np.uint64)
            for first in range(0, values.size, 4096):
                some = values[first : first + 4096]
                words = code.around(some)
                row, at = np.nonzero(code.anchor(words) == anchors[first : first + 4096, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[row, at].view(np.int64)), pa.array(some[row].view(np.int64))], names=["word", "node"]
                )

    members = materialize(nodes.select("node").mapInArrow(replicated, "anchor long, node long"), "simhash-anchors")
    ends = members.groupBy("anchor").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = materialize(ends.where(F.col("low") < F.col("high")).select("anchor"), "simhash-shared")
    near = join_small(members, shared, "anchor", F.col("node")).select("anchor", "node")
    met = near.mapInArrow(cells, "word long, node long").groupBy("word").agg(F.sort_array(F.collect_set("node")).alias("all"))
    met = met.where(F.size("all") > 1)
    if max_bits % 2 == 0:
        pairs = met.select(F.col("all")[0].alias("a"), F.explode(F.expr("slice(all, 2, size(all) - 1)")).alias("b"))
    else:
        pairs = met.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a < b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.where(close).distinct()


def components(printed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Per fingerprint: node and label; the label is the first document of its component.

    Documents are ordered by id, null ids last, then by a hash of the text.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "tie", "node"))
    nodes = materialize(printed.groupBy("node").agg(first.alias("label")), "simhash-nodes")
    pairs = materialize(links(nodes, max_bits), "simhash-links")
    edges = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "simhash-edges")
    found = least_labels(edges, nodes).withColumnRenamed("label", "least")
    return nodes.join(found, "node", "left").select("node", F.coalesce("least", "label").alias("label"))


def classes(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, node (fingerprint) and component_id, the least id that links reach."""
    printed = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    labels = materialize(components(printed, max_bits).select("node", F.col("label.doc_id").alias("component_id")), "simhash-classes")
    # Copies, and texts without words, share a fingerprint however many they are.
    return hot_join(printed, labels, "node").select("doc_id", "node", "component_id")


def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The first document of each component, as it came; of rows equal in id and text, one stays."""
    printed = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    labels = components(printed, max_bits)
    keepers = labels.where(F.col("label.node") == F.col("node")).select(
        F.coalesce(F.col("label.doc_id").cast("string"), F.lit("")).alias("key"), F.col("label.tie").alias("tie")
    )
    keepers = materialize(keepers, "simhash-keepers")
    rows = docs.select(
        F.struct("*").alias("doc"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
        F.xxhash64(text_col).alias("tie"),
    )
    # How often a kept row occurs is counted on the narrow table; only rows that repeat meet once more.
    counts = printed.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "tie").agg(F.count("*").alias("times"))
    chosen = rows.join(keepers.join(counts, ["key", "tie"]).hint("merge"), ["key", "tie"])
    single = chosen.where("times = 1").select("doc")
    again = chosen.where("times > 1").groupBy("key", "tie").agg(F.first("doc").alias("doc")).select("doc")
    return single.unionByName(again).select("doc.*")
