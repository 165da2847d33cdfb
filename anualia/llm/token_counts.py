"""Word-piece counts by a linear longest-match automaton.

A word is cut greedily into the longest pieces of a vocabulary: the first piece
starts with the word mark, the others do not. The trie of all pieces gets a
failure link and a popped count at every node. The link leads to the node of
what is left after the longest pieces of the node's text are taken off, the
count says how many they are. Reading a word then takes one step forward or one
link for every byte, never goes back, and adds up counts without building a
piece.

The automaton is built once on the driver from the vocabulary and broadcast; its
size depends on the vocabulary alone. Words repeat, so each task remembers the
counts of up to ``REMEMBERED`` words and starts anew when that is full.

Defined results: null and blank texts have no words and no tokens; a word that
the vocabulary cannot cover counts as one unknown token; repeated rows are each
counted; an empty table gives no rows. Extra columns are ignored, whatever
their names are.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = b" "
REMEMBERED = 400_000


class Automaton:
    """Trie with failure links and popped counts; node 0 is the root."""

    def __init__(self, pieces: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node
        self.link: list[int] = [-1]
        self.popped: list[int] = [0]
        ends = {self._insert(p) for p in pieces if p}
        self._connect(ends)

    def _insert(self, piece: bytes) -> int:
        node = 0
        for byte in piece:
            key = node << 8 | byte
            node = self.step.get(key, -1)
            if node < 0:
                node = self.step[key] = len(self.link)
                self.link.append(-1)
                self.popped.append(0)
        return node

    def _connect(self, ends: set[int]) -> None:
        """Links and counts, parents first: nodes were numbered along each insertion, so walk by depth."""
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.step.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        level = [0]
        while level:
            below = []
            for parent in level:
                for byte, node in children.get(parent, ()):
                    below.append(node)
                    if node in ends:
                        self.link[node], self.popped[node] = 0, 1
                        continue
                    taken, at = self.popped[parent], self.link[parent]
                    while at >= 0 and (at << 8 | byte) not in self.step:
                        taken += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.step[at << 8 | byte], taken
            level = below

    def count(self, text: bytes) -> int:
        """Pieces of one marked word; one if it cannot be cut."""
        step, link, popped = self.step, self.link, self.popped
        node = pieces = 0
        for byte in text:
            following = step.get(node << 8 | byte, -1)
            while following < 0:
                pieces += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                following = step.get(node << 8 | byte, -1)
            node = following
        while node:
            pieces += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return pieces


class Remembered(dict):
    """Counts by word; a word that is not there is read by the automaton."""

    def __init__(self, automaton: Automaton, mark: bytes):
        super().__init__()
        self._automaton, self._mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self._automaton.count(self._mark + word)
        return found


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizer file; those that begin a word start with a space. Specials are left out."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    special = {t["content"] for t in content.get("added_tokens", ())}
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in piece) for piece in content["model"]["vocab"] if piece not in special]


def count_tokens(docs: DataFrame, pieces: list[bytes], mark: bytes = MARK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Remembered(shared.value, mark)
        for batch in batches:
            words = [t.split() if t else [] for t in batch.column(1).to_pylist()]
            tokens = [sum(map(counts.__getitem__, w)) for w in words]
            columns = [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
