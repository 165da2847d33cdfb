"""Bit-wise context mixing over a word alphabet: the model, on arrays.

Symbols are the 256 bytes, a word end, a text end and the head words. A token is
its head word, or else its bytes and a word end. A symbol is a path of yes/no
decisions in a Huffman tree. Each decision is predicted in several contexts: by
its node alone, and by its node with the last one, two and three symbols, hashed
into tables of counts. The predictions' log-odds are mixed with weights picked by
a gate (depth in the tree, and whether a word is being spelled). While a text is
coded, the weights of its gates are refined for each predictor by online gradient
steps, ``BLOCK`` symbols at a time, from the first symbol to the last. Texts are
coded side by side, each with weights of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_END, TEXT_END, FIRST_WORD = 256, 257, 258
ORDERS = 3  # hashed contexts
LEAST_BITS, MOST_BITS = 20, 22  # of the tables of counts
TOKENS_A_SLOT = 64
SEGMENT = 256
BLOCK = 16
DEPTHS = 8
RATE = 0.01
PRIOR = 0.4
START = np.array([0.6, 0.4, 0.4, 0.4, 0.0], np.float32)  # weights from which the fit begins: order 0, hashed orders, bias
DAMPING = 20.0  # how many decisions they stand for
ODDS_STEPS = 12
PIECE = 1 << 15  # symbols coded at once
LOOKED_UP_AT_ONCE = 1 << 15  # symbols whose places in the tables are looked up at once
COUNTED_AT_ONCE = 1 << 14  # symbols after contexts that are counted at once
_MIX = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_NODE = np.uint32(0x27D4EB2F)
_SPREAD = np.uint32(0x165667B1)


def table_bits(tokens: int) -> int:
    """Tables of counts grow with the training text, a slot for some 64 tokens, up to a size that fits a task."""
    return min(max(int(tokens // TOKENS_A_SLOT).bit_length(), LEAST_BITS), MOST_BITS)


@dataclass(frozen=True)
class Alphabet:
    """Head words in the order of their symbols, and for each symbol its path through the tree: nodes, bits and gates (twice the depth, limited)."""

    words: pa.Array
    start: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    gate: np.ndarray

    @classmethod
    def build(cls, words: pa.Array | list[str], weights: np.ndarray) -> Alphabet:
        """Huffman tree over ``FIRST_WORD + len(words)`` symbols; every symbol has a code."""
        n = len(weights)
        heap = [(int(w) + 1, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        for node in range(n, 2 * n - 1):
            (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = node
            side[b] = 1
            heapq.heappush(heap, (w0 + w1, node))
        root = 2 * n - 2
        steps, marks = [], []
        at, alive = np.arange(n), np.arange(n)
        while alive.size:
            steps.append((alive, parent[at] - n, side[at]))
            at = parent[at]
            marks.append(alive)
            alive, at = alive[at != root], at[at != root]
        length = np.bincount(np.concatenate(marks), minlength=n)
        start = np.concatenate([[0], length.cumsum()])
        nodes, bits = np.zeros(start[-1], np.uint32), np.zeros(start[-1], np.uint8)
        for k, (who, inner, bit) in enumerate(steps):  # from the leaf up, stored from the root down
            place = start[who] + length[who] - 1 - k
            nodes[place], bits[place] = inner, bit
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        depth = np.arange(start[-1]) - np.repeat(start[:-1], length)
        gate = (np.minimum(depth, DEPTHS - 1) * 2).astype(np.uint8)
        return cls(words, start[:-1].astype(np.int32), length.astype(np.int32), nodes, bits, gate)

    @cached_property
    def hashed(self) -> np.ndarray:
        """Each step's node, as it goes into the hash of a place."""
        return self.nodes * _NODE

    @cached_property
    def marks(self) -> np.ndarray:
        """Each step's gate, and 128 where its decision is a one."""
        return self.gate | self.bits << np.uint8(7)

    @cached_property
    def by_length(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbols from the shortest path to the longest, and the rank of each among them."""
        symbols = np.argsort(self.length, kind="stable")
        rank = np.empty(len(symbols), np.uint64)
        rank[symbols] = np.arange(len(symbols), dtype=np.uint64)
        return symbols, rank

    def levels(self, symbols: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Steps of symbols given by length, level by level: depth, the first symbol that has a step there, places of these steps (until the next level)."""
        length, at = self.length[symbols], self.start[symbols].astype(np.intp)
        firsts = np.searchsorted(length, np.arange(length.max(initial=0)), "right")
        for depth, first in enumerate(firsts.tolist()):
            yield depth, first, at[first:]
            at[first:] += 1

    def path(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the symbols' steps, one symbol after the other, and how many steps each has."""
        counts = self.length[symbols]
        path = np.repeat(self.start[symbols] - (counts.cumsum(dtype=np.intp) - counts), counts)
        path += np.arange(len(path))
        return path, counts

    def spell(self, texts: pa.Array) -> Spelled:
        """Symbols of texts, lower-cased in A-Z, one after the other."""
        return next(self.spell_each([texts]))

    def spell_each(self, several: Iterable[pa.Array]) -> Iterator[Spelled]:
        """Symbols of several arrays of texts, whose words are looked up in one go: each time, the head is hashed anew."""
        split = [(len(texts), *split_words(texts)) for texts in several]
        known = pc.index_in(pa.chunked_array([words for _, _, words in split], pa.string()), value_set=self.words)
        known, first = pc.fill_null(known, -1).to_numpy(), 0
        for size, offsets, words in split:
            yield self._spelled(size, offsets, words, known[first : first + len(words)])
            first += len(words)

    def _spelled(self, texts: int, offsets: np.ndarray, words: pa.Array, known: np.ndarray) -> Spelled:
        other = np.flatnonzero(known < 0)
        rest = words.take(pa.array(other))
        begins = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
        letters = np.diff(begins)[other].astype(np.int64)
        sizes = np.ones(len(words), np.int64)
        sizes[other] += letters
        # Every text has one more symbol, its end, which moves the words of later texts on.
        number = np.repeat(np.arange(texts), np.diff(offsets))
        stops = sizes.cumsum() + number
        lengths = np.diff(np.append(0, sizes.cumsum())[offsets]) + 1
        out = np.full(int(lengths.sum()), TEXT_END, np.int32)
        out[stops - 1] = np.where(known < 0, WORD_END, known + FIRST_WORD)  # a spelled word ends with its word end
        if len(other):
            within = np.arange(int(letters.sum())) - np.repeat(letters.cumsum() - letters, letters)
            data = np.frombuffer(words.buffers()[2], np.uint8)
            out[np.repeat(stops[other] - sizes[other], letters) + within] = data[np.repeat(begins[other], letters) + within]
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(out)) - np.repeat(lengths.cumsum() - lengths, lengths)
        return Spelled(out, text, place, rest, number[other])


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """All words of the texts, lower-cased in A-Z if asked for, and where each text's words begin."""
    plain = pc.fill_null(texts, "")
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(plain) if lower else plain)
    lists = pc.ascii_split_whitespace(plain)
    counts = np.where(pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
    words = lists.flatten()
    if (counts == 0).any():  # a blank text gives one empty word
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return np.append(0, counts.cumsum()).astype(np.int64), words


@dataclass(frozen=True)
class Spelled:
    """Symbols of several texts with their text and place in it; words outside the head with their text."""

    symbols: np.ndarray
    text: np.ndarray
    place: np.ndarray
    rest: pa.Array
    rest_text: np.ndarray

    def contexts(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Context hashes, and whether the symbol before was a byte; before a text all are text ends."""
        before = []
        for back in range(1, ORDERS + 1):
            past = np.full(len(self.symbols), TEXT_END, np.uint32)
            past[back:] = self.symbols[:-back]
            past[self.place < back] = TEXT_END
            before.append(past)
        value, found = np.zeros(len(self.symbols), np.uint32), []
        for back, (past, factor) in enumerate(zip(before, _MIX), 1):
            value = (value + past + np.uint32(back)) * factor
            value ^= value >> np.uint32(15)
            found.append(value)
        return found, (before[0] < WORD_END).astype(np.uint8)


def slots(alphabet: Alphabet, path: np.ndarray, counts: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Place in the table for each step of the path, after contexts with these hashes."""
    at = alphabet.nodes.take(path, mode="clip")
    at *= _NODE
    at ^= np.repeat(hashes, counts)
    at *= _SPREAD
    at >>= np.uint32(32 - bits)
    return at


def count(alphabet: Alphabet, parts: Iterable[Spelled], bits: int) -> np.ndarray:
    """Counts of zeros and ones for each hashed context and table place: one flat array.

    A symbol after a context is looked at once for each part in which it occurs, however often it does.
    """
    cells = 2 << bits
    table = np.zeros((ORDERS, cells), np.uint32)
    by_length, rank = alphabet.by_length
    for spelled in parts:
        hashes, _ = spelled.contexts()
        ranks = rank[spelled.symbols] << np.uint64(32)
        for counts, h in zip(table, hashes):
            keys, times = np.unique(ranks | h, return_counts=True)
            symbols, contexts, times = by_length[keys >> np.uint64(32)], keys.astype(np.uint32), times.astype(np.uint32)
            for first in range(0, len(keys), COUNTED_AT_ONCE):
                some = slice(first, first + COUNTED_AT_ONCE)
                after, often = contexts[some], times[some]
                for _, alive, steps in alphabet.levels(symbols[some]):
                    at = alphabet.hashed.take(steps, mode="clip")
                    at ^= after[alive:]
                    at *= _SPREAD
                    at >>= np.uint32(32 - bits)
                    at <<= np.uint32(1)
                    at |= alphabet.bits.take(steps, mode="clip")
                    np.add.at(counts, at.astype(np.intp), often[alive:])
    return table.reshape(-1)


def stretched(counts: np.ndarray) -> np.ndarray:
    """Log-odds of places from their flat counts, in steps of 1 / ODDS_STEPS."""
    pairs = counts.reshape(-1, 2).astype(np.float32) + np.float32(PRIOR)
    odds = np.log(pairs[:, 1] / pairs[:, 0])
    return np.clip(np.rint(odds * ODDS_STEPS), -127, 127).astype(np.int8)


def sizes(counts: np.ndarray) -> np.ndarray:
    """How often each place was seen: logarithms in eighths of an octave, up to 2^15."""
    total = counts.reshape(-1, 2).sum(1).astype(np.float32)
    return np.clip(np.rint(8 * np.log2(total + 1)), 0, 127).astype(np.int8)


@dataclass(frozen=True)
class Model:
    alphabet: Alphabet
    node_odds: np.ndarray  # order 0
    tables: np.ndarray
    weights: np.ndarray  # gates x (orders + 2): order 0, hashed orders, bias

    @cached_property
    def step_odds(self) -> np.ndarray:
        """Order 0 of each step of the alphabet's paths."""
        return self.node_odds[self.alphabet.nodes]

    @property
    def table_bits(self) -> int:
        return int(self.tables.shape[1]).bit_length() - 1

    def bits(self, spelled: Spelled, texts: int) -> np.ndarray:
        """Bits that each text costs."""
        hashes, after = spelled.contexts()
        # Blocks in the order of their place in the text: a block of all texts is one slice.
        step = spelled.place // BLOCK
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        step, text = step[order], spelled.text[order]
        new = np.ones(len(order), bool)
        new[1:] = (step[1:] != step[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        step, text = step[first], text[first]
        # Every text refines weights of its own, from its beginning to its end.
        weights = np.repeat(self.weights.T[:, None, :], texts, axis=1)
        total = np.zeros(texts)
        at = 0
        while at < len(first):
            stop = int(np.searchsorted(first, first[at] + PIECE))
            some = order[first[at] : first[stop] if stop < len(first) else len(order)]
            symbols, before = spelled.symbols[some], [h[some] for h in hashes]
            self._code(symbols, before, after[some], step[at:stop], text[at:stop], first[at:stop] - first[at], weights, total)
            at = stop
        return total * float(1 / np.log(2))

    def _code(
        self, symbols: np.ndarray, hashes: list[np.ndarray], after_byte: np.ndarray, step: np.ndarray, text: np.ndarray, first: np.ndarray,
        weights: np.ndarray, total: np.ndarray,
    ) -> None:
        """Code blocks, given by their first symbols; add to the costs of their texts and refine these texts' weights."""
        path, counts = self.alphabet.path(symbols)
        begins = np.append(0, counts.cumsum())[np.append(first, len(counts))]
        nodes = self.alphabet.hashed.take(path, mode="clip")
        odds = np.empty((ORDERS, len(path)), np.int8)
        for row, t, h in zip(odds, self.tables, hashes):  # places as in ``slots``
            at = np.repeat(h, counts)
            at ^= nodes
            at *= _SPREAD
            at >>= np.uint32(32 - self.table_bits)
            t.take(at.astype(np.intp), mode="clip", out=row)
        node_odds = self.step_odds.take(path, mode="clip")
        marks = self.alphabet.marks.take(path, mode="clip")
        sign = (marks >> np.uint8(6) & np.uint8(2)).astype(np.float32)
        sign -= 1
        marks &= np.uint8(127)
        groups = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step))
        number = np.arange(len(step)) - np.repeat(groups[:-1], np.diff(groups))
        base = np.repeat(number * (DEPTHS * 2), np.diff(np.append(first, len(counts)))) + after_byte
        place = np.repeat(base, counts)
        place += marks
        cost = np.empty(len(path), np.float32)
        for low, high in zip(groups[:-1].tolist(), groups[1:].tolist()):
            a, b = int(begins[low]), int(begins[high])
            texts, here, y = text[low:high], place[a:b], sign[a:b]
            inputs = [node_odds[a:b], *(odds[:, a:b] * np.float32(1 / ODDS_STEPS))]
            own = weights[:, texts].reshape(len(weights), -1)
            z = own[-1].take(here, mode="clip")
            product = np.empty_like(z)
            for w, v in zip(own, inputs):
                w.take(here, mode="clip", out=product)
                product *= v
                z += product
            # Probability of the decision taken; the other one has the rest.
            z *= y
            np.clip(z, -15, 15, out=z)
            np.negative(z, out=z)
            p = np.exp(z, out=z)
            p += 1
            cost[a:b] = p
            error = np.divide(-1, p, out=p)
            error += 1
            error *= y
            error *= np.float32(RATE)
            for w, v in zip(own, inputs):
                w += np.bincount(here, np.multiply(error, v, out=product), len(w))
            own[-1] += np.bincount(here, error, own.shape[1])
            weights[:, texts] = own.reshape(len(weights), len(texts), -1)
        np.log(cost, out=cost)
        total += np.bincount(text, np.add.reduceat(cost, begins[:-1], dtype=np.float64), len(total))


def _left_out() -> np.ndarray:
    """Log-odds of a table place without the decision itself: by the decision, the place's log-odds and its size."""
    share = 1 / (1 + np.exp(-np.arange(256, dtype=np.uint8).view(np.int8).astype(float) / ODDS_STEPS))[:, None]
    total = np.exp2(np.arange(256) / 8) - 1 + 2 * PRIOR
    found = []
    for y in (0, 1):
        ones, zeros = np.maximum(share * total - PRIOR - y, 0), np.maximum((1 - share) * total - PRIOR - (1 - y), 0)
        found.append(np.log((ones + PRIOR) / (zeros + PRIOR)))
    return np.stack(found).reshape(-1).astype(np.float32)


def _alike(symbols: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One place of each symbol after the same contexts, in the order of ``symbols``, and how often it occurs."""
    keys = symbols << np.uint64(32) | hashes[-1]
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = False
    for values in (keys, *hashes[:-1]):
        sorted_values = values[order]
        new[1:] |= sorted_values[1:] != sorted_values[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order))).astype(np.float32)


def weight_sums(alphabet: Alphabet, node_odds: np.ndarray, both: np.ndarray, parts: Iterable[Spelled]) -> np.ndarray:
    """What the fit of the gate weights needs of some texts: slope and curvature of the costs of all decisions, by gate.

    The sums of several tasks add up, so the fit does not hang on the order of
    texts. ``both`` holds log-odds and sizes of the tables, a byte each. The texts
    were counted, so each decision is taken out of its own prediction. A symbol
    after the same three is looked at once for each part, and weighs as often as it occurs.
    """
    bits = int(both.shape[1]).bit_length() - 1
    inputs = ORDERS + 2
    left_out = _left_out()
    step_odds = node_odds[alphabet.nodes]
    by_length, rank = alphabet.by_length
    sums = np.zeros((DEPTHS * 2, inputs + 1, inputs))
    for spelled in parts:
        hashes, after = spelled.contexts()
        for side in (0, 1):
            here = np.flatnonzero(after == side)
            some, times = _alike(rank[spelled.symbols[here]], [h[here] for h in hashes])
            some = here[some]
            symbols, contexts = spelled.symbols[some], [h[some] for h in hashes]
            for first in range(0, len(some), LOOKED_UP_AT_ONCE):
                piece = slice(first, first + LOOKED_UP_AT_ONCE)
                often = times[piece]
                levels = [(depth, alive, steps.copy()) for depth, alive, steps in alphabet.levels(symbols[piece])]
                cuts = np.cumsum([0] + [len(steps) for _, _, steps in levels]).tolist()
                # One table at a time, so that much of it stays in the processor's caches.
                found = np.empty((ORDERS, cuts[-1]), np.uint16)
                for row, table, h in zip(found, both, contexts):
                    h = h[piece]
                    for (_, alive, steps), a, b in zip(levels, cuts, cuts[1:]):
                        at = alphabet.hashed.take(steps, mode="clip")
                        at ^= h[alive:]
                        at *= _SPREAD
                        at >>= np.uint32(32 - bits)
                        table.take(at.astype(np.intp), mode="clip", out=row[a:b])
                for (depth, alive, steps), a, b in zip(levels, cuts, cuts[1:]):
                    y = alphabet.bits.take(steps, mode="clip")
                    x = np.empty((inputs, len(steps)), np.float32)
                    step_odds.take(steps, mode="clip", out=x[0])
                    x[-1] = 1
                    known = y.astype(np.intp) << 16
                    for row, cells in zip(x[1:], found[:, a:b]):
                        left_out.take(known | cells, mode="clip", out=row)
                    z = START[0] * x[0]
                    for s, row in zip(START[1:-1], x[1:]):
                        z += s * row
                    np.clip(z, -15, 15, out=z)
                    p = 1 / (1 + np.exp(-z))
                    slope, weight = (y - p) * often[alive:], p * (1 - p) * often[alive:]
                    gate = 2 * min(depth, DEPTHS - 1) + side
                    sums[gate, 0] += x @ slope
                    for i, weighted in enumerate(x * weight):
                        for j in range(i + 1):
                            sums[gate, 1 + i, j] += weighted @ x[j]
    upper = np.triu_indices(inputs, 1)
    sums[:, 1 + upper[0], upper[1]] = sums[:, 1 + upper[1], upper[0]]
    return sums


def fit_weights(sums: np.ndarray) -> np.ndarray:
    """Gate weights by a damped Newton step from ``START``."""
    curve = sums[:, 1:] + DAMPING * np.eye(sums.shape[2])
    return (START + np.linalg.solve(curve, sums[:, 0, :, None])[:, :, 0]).astype(np.float32)
