"""A covering code of 64-bit words, used as anchors.

The code is the direct sum of four perfect codes over consecutive bits: two
binary Golay codes of length 23 (covering radius 3 each), a Hamming code of
length 15 (radius 1) and a repetition code of length 3 (radius 1). Every word
has one nearest codeword in each part, its anchor, at most 8 bits away in all.
There are 2**36 anchors.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 64
RADIUS = 8
_GOLAY = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(value: int, generator: int) -> int:
    width = generator.bit_length()
    while value.bit_length() >= width:
        value ^= generator << value.bit_length() - width
    return value


def _leaders(length: int, radius: int, syndrome_bits: int, syndromes: list[int]) -> np.ndarray:
    """The one pattern of at most ``radius`` bits for each syndrome of a perfect code."""
    table = np.zeros(1 << syndrome_bits, np.uint64)
    for weight in range(1, radius + 1):
        for bits in combinations(range(length), weight):
            key = 0
            for b in bits:
                key ^= syndromes[b]
            table[key] = sum(1 << b for b in bits)
    return table


class _Part:
    """Nearest codewords of one perfect linear code, by syndrome."""

    def __init__(self, shift: int, length: int, radius: int, syndrome_bits: int, syndromes: list[int]):
        self._shift, self._mask = np.uint64(shift), np.uint64((1 << length) - 1)
        self._leader = _leaders(length, radius, syndrome_bits, syndromes)
        self._bytes = []
        for first in range(0, length, 8):
            table = np.zeros(256, np.uint32)
            for value in range(256):
                for b in range(8):
                    if value >> b & 1 and first + b < length:
                        table[value] ^= syndromes[first + b]
            self._bytes.append(table)

    def nearest(self, words: np.ndarray) -> np.ndarray:
        block = words >> self._shift & self._mask
        key = np.zeros(words.shape, np.uint32)
        for i, table in enumerate(self._bytes):
            key ^= table[(block >> np.uint64(8 * i) & np.uint64(255)).astype(np.intp)]
        return (block ^ self._leader[key]) << self._shift


def _parts() -> list[_Part]:
    golay = [_remainder(1 << i, _GOLAY) for i in range(23)]
    return [
        _Part(0, 23, 3, 11, golay),
        _Part(23, 23, 3, 11, golay),
        _Part(46, 15, 1, 4, list(range(1, 16))),
        _Part(61, 3, 1, 2, [1, 2, 3]),
    ]


class Code:
    """Anchors of words, and the words around a fingerprint."""

    def __init__(self, reach: int):
        """``reach``: bits by which a word around a fingerprint may differ from it."""
        self._parts = _parts()
        masks = [sum(1 << b for b in bits) for w in range(reach + 1) for bits in combinations(range(BITS), w)]
        self._masks = np.array(masks, np.uint64)

    def anchor(self, words: np.ndarray) -> np.ndarray:
        """The nearest codeword of each word."""
        out = np.zeros(words.shape, np.uint64)
        for part in self._parts:
            out |= part.nearest(words)
        return out

    def around(self, fingerprints: np.ndarray) -> np.ndarray:
        """One row for each fingerprint: all words within the reach."""
        return fingerprints[:, None] ^ self._masks[None, :]

    def anchors_around(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors of the words around each fingerprint: (row, anchor)."""
        found = np.sort(self.anchor(self.around(fingerprints)), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        return np.nonzero(new)[0], found[new]
