"""Periodic stretches of words ("runs") in whole texts.

A run is a stretch of consecutive words with smallest period q and a length of at
least ``max(12, 2 * q)`` that neither neighbour extends. Every run with period q
holds two equal words at places k * q and (k + 1) * q for some k. So for each q the
harmonic grid of the multiples of q is walked: the pairs of equal words on it are
extended in both directions by longest common extensions (``common_extensions``,
one structure forwards and one backwards), and a pair whose extensions add up to q
words or more lies in a run. A run of a smaller period is found again for its
multiples; the least period of a stretch is kept.

Texts are read in parts of some megabytes, their words numbered and set one after
the other, longest text first, with a word that occurs once between them, so that
the grid of q ends with the last text of 2 * q words. The two structures hold the
texts that still have pairs after some direct comparisons around each of them.
Work grows with n log n in the words of a part; a text is held whole.

Defined results: a null or empty text has no words and no runs; rows are measured
each for itself, whatever their ids; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anualia.llm.common import parts
from anualia.llm.common_extensions import Extensions
from anualia.llm.context_mixing import split_words

LEAST_LENGTH = 12
PAIRS_AT_ONCE = 1 << 20
_IN_A_ROW = LEAST_LENGTH // 2  # so many pairs at least are equal in a row in a run

SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of all runs in texts given one after the other, by text, start and period."""
    order = np.argsort(-sizes, kind="stable")
    firsts = sizes.cumsum() - sizes
    some = order[sizes[order] >= LEAST_LENGTH]
    joined, begins = _joined(words, firsts[some], sizes[some])
    pairs = _grid(joined, begins, sizes[some])
    # Both words of a pair lie in one text; only the texts with pairs left go on.
    of, to = (np.searchsorted(begins, x, "right") - 1 for x in (pairs[0], pairs[0] + pairs[1]))
    pairs, of = (pairs[0][of == to], pairs[1][of == to]), of[of == to]
    if not len(of):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    there = np.unique(of)
    joined, moved = _joined(words, firsts[some[there]], sizes[some[there]])
    i = pairs[0] - begins[of] + moved[np.searchsorted(there, of)]
    start, stop, period = _extended(joined, i, pairs[1])
    at = np.searchsorted(moved, start, "right") - 1
    text, start, length = some[there[at]], start - moved[at], stop - start
    rank = np.lexsort((period, start, text))
    return text[rank], start[rank], length[rank], period[rank]


def _joined(words: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a word of its own before, between and after them, and where each text begins."""
    stops = (sizes + 1).cumsum()
    begins = stops - sizes
    out = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
    single = np.append(0, stops)
    out[single] = int(words.max(initial=0)) + 1 + np.arange(len(single))
    held = np.ones(len(out), bool)
    held[single] = False
    out[held] = words[np.repeat(firsts - (sizes.cumsum() - sizes), sizes) + np.arange(int(sizes.sum()))]
    return out, begins


def _grid(joined: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods q with equal words at i and i + q, both on the grid of q, and some equal pairs around."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, int]] = []
    reach = int(sizes[0]) // 2 if len(sizes) else 0
    # Texts are in falling order of size: those of 2 q words come first.
    texts = np.searchsorted(-sizes, -2 * np.arange(1, reach + 1), "right")
    ends = (begins[texts - 1] + sizes[texts - 1]).tolist() if reach else []
    size = 0
    for q in range(1, reach + 1):
        on = joined[: ends[q - 1] : q]
        equal = np.flatnonzero(on[1:] == on[:-1])
        if len(equal):
            waiting.append((equal, q))
            size += len(equal)
        if waiting and (size >= PAIRS_AT_ONCE or q == reach):
            period = np.repeat([q for _, q in waiting], [len(e) for e, _ in waiting])
            found.append(_near(joined, np.concatenate([e for e, _ in waiting]) * period, period))
            waiting, size = [], 0
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([q for _, q in found])


def _near(joined: np.ndarray, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stand among ``_IN_A_ROW`` equal pairs in a row."""
    row = np.ones(len(i), np.int64)
    for step in (1, -1):
        open_ = np.arange(len(i))
        for k in range(step, step * _IN_A_ROW, step):
            a, b = i[open_] + k, i[open_] + q[open_] + k
            # Past both ends there is nothing equal; single words stand at the ends.
            open_ = open_[joined.take(a, mode="clip") == joined.take(b, mode="clip")]
            if not len(open_):
                break
            row[open_] += 1
    kept = row >= _IN_A_ROW
    return i[kept], q[kept]


def _extended(joined: np.ndarray, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and least period of the stretches around the pairs that are long enough."""
    n = len(joined)
    slices = [slice(at, at + PAIRS_AT_ONCE) for at in range(0, len(i), PAIRS_AT_ONCE)]
    reach = Extensions(joined)
    ahead = [reach(i[s], i[s] + q[s]) for s in slices]
    reach = Extensions(joined[::-1])
    found = []
    for s, more in zip(slices, ahead):
        behind = reach(n - i[s], n - i[s] - q[s])
        long = (more + behind >= q[s]) & (more + behind + q[s] >= LEAST_LENGTH)
        found.append(_least((i[s] - behind)[long], (i[s] + more + q[s])[long], q[s][long]))
    return _least(*(np.concatenate(c) for c in zip(*found)))


def _least(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its least period."""
    rank = np.lexsort((period, stop, start))
    start, stop, period = start[rank], stop[rank], period[rank]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return start[new], stop[new], period[new]


def measure(docs: DataFrame, carried: tuple[str, ...], words_of: str = "text", bent: tuple[str, str] | None = None) -> DataFrame:
    """The carried columns with n_words, all runs by start and period, and the text without repeats.

    A word goes that any run holds after its first period; the others are joined by
    one space. ``bent`` names two columns, a first word a (null: none) and a period
    p: every word from a on becomes the word at a + (i - a) % p before the text is measured.
    """
    chosen = docs.select(*carried, F.col(words_of).alias("_text"), *(F.col(c).alias(f"_bent{k}") for k, c in enumerate(bent or ())))
    names = list(carried)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, len(names))):
            texts = part.column(len(names))
            offsets, words = split_words(texts, lower=False)
            coded = words.dictionary_encode()
            ids, spelled = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            sizes = np.diff(offsets)
            if bent:
                ids = _bent(ids, offsets, *(part.column(len(names) + 1 + k) for k in range(2)))
            text, start, length, period = find_runs(ids, sizes)
            counts = np.bincount(text, minlength=len(sizes))
            kept = np.ones(len(ids), bool)
            for t, a, b in zip(text.tolist(), (start + period).tolist(), (start + length).tolist()):
                kept[offsets[t] + a : offsets[t] + b] = False
            left = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(kept))[offsets], pa.int32()), spelled.take(pa.array(ids[kept])).cast(pa.string())
            )
            runs = pa.ListArray.from_arrays(
                pa.array(np.append(0, counts.cumsum()), pa.int32()),
                pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"]),
            )
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(names)], pa.array(sizes), runs, pc.binary_join(left, " ")], names=[*names, "n_words", "runs", "kept"]
            )

    kinds = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in names)
    return chosen.mapInArrow(measured, f"{kinds}, {SCHEMA}")


def _bent(ids: np.ndarray, offsets: np.ndarray, first: pa.Array, period: pa.Array) -> np.ndarray:
    """The words of each text with its own words repeated in their places."""
    out = ids.copy()
    for t in np.flatnonzero(pc.is_valid(first).to_numpy(zero_copy_only=False)).tolist():
        a, p = int(offsets[t]) + first[t].as_py(), period[t].as_py()
        out[a : offsets[t + 1]] = np.resize(ids[a : a + p], offsets[t + 1] - a)
    return out


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run, and hashes of all runs and of the text without repeats, beside the first columns."""
    longest = F.expr("""try_element_at(array_sort(runs, (x, y) -> CASE
        WHEN x.length <> y.length THEN IF(x.length > y.length, -1, 1)
        WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) ELSE IF(x.period < y.period, -1, 1) END), 1)""")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', string(r.start), string(r.length), string(r.period)) || '\n'), '')")
    named = [c for c in found.columns if c not in ("n_words", "runs", "kept")]
    return found.select("*", longest.alias("_run")).select(
        *named, F.size("runs").cast("long").alias("n_runs"), "_run.start", "_run.length", "_run.period",
        F.expr("(1000 * _run.length) DIV _run.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
