"""Directly addressable codes for token ids.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first
chunk of every id, level 1 the second chunk of the ids that have one, and so on.
Each level has a bitmap that says which of its ids go on, and a rank directory
with the number of set bits before every block of 512 bits. The place of an id
in the next level is the number of ids before it that go on, so any id is found
with one rank look-up a level and nothing around it is decoded.

Layout, little-endian: magic ``DAC1``, levels (u32), ids (u64), then for each
level its length (u64), chunks (u8 each), bitmap (padded to whole blocks) and
rank directory (u64 each, one more than there are blocks).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK_BITS = 512
_HEAD = struct.Struct("<4sIQ")
_LENGTH = struct.Struct("<Q")


def encode(ids: np.ndarray) -> bytes:
    """One array of ids below 2**32 as a blob."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    parts, levels = [], 0
    while levels == 0 or rest.size:
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.pad(bits, (0, -bits.size % (BLOCK_BITS // 8)))
        per_block = np.bitwise_count(bits.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(per_block, dtype=np.uint64)])
        parts += [_LENGTH.pack(rest.size), rest.astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
        rest = rest[goes_on] >> 8
        levels += 1
    return b"".join([_HEAD.pack(MAGIC, levels, ids.size), *parts])


class Reader:
    """Access to the ids of one blob by place."""

    def __init__(self, blob: bytes):
        magic, levels, self.size = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a blob of addressable codes")
        self._levels, at = [], _HEAD.size
        for _ in range(levels):
            (length,) = _LENGTH.unpack_from(blob, at)
            at += _LENGTH.size
            chunks = np.frombuffer(blob, np.uint8, length, at)
            at += length
            blocks = -(-length // BLOCK_BITS)
            bits = np.frombuffer(blob, np.uint8, blocks * BLOCK_BITS // 8, at)
            at += bits.size
            ranks = np.frombuffer(blob, "<u8", blocks + 1, at)
            at += 8 * (blocks + 1)
            self._levels.append((chunks, bits, ranks))

    def _rank(self, level: int, place: int) -> int:
        """Ids before ``place`` that go on to the next level."""
        _, bits, ranks = self._levels[level]
        block, inside = divmod(place, BLOCK_BITS)
        first = block * BLOCK_BITS // 8
        whole = bits[first : first + inside // 8]
        count = int(ranks[block]) + int(np.bitwise_count(whole).sum())
        if inside % 8:
            count += int(bits[first + inside // 8] & ((1 << inside % 8) - 1)).bit_count()
        return count

    def __getitem__(self, place: int) -> int:
        """One id, from one chunk a level."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        value = 0
        for level, (chunks, bits, _) in enumerate(self._levels):
            value |= int(chunks[place]) << 8 * level
            if not bits[place >> 3] >> (place & 7) & 1:
                break
            place = self._rank(level, place)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``."""
        out = np.zeros(max(stop - start, 0), np.uint32)
        if not out.size:
            return out
        at = np.arange(out.size)
        for level, (chunks, bits, _) in enumerate(self._levels):
            out[at] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            first = start >> 3
            flags = np.unpackbits(bits[first : (stop + 7) >> 3], bitorder="little")[start - 8 * first : stop - 8 * first]
            at = at[flags.astype(bool)]
            if not at.size:
                break
            start = self._rank(level, start)
            stop = start + at.size
        return out
