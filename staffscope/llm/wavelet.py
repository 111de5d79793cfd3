"""A file of token ids as a wavelet matrix: one plane of bits per level, each split stably by the bit above it.

Access, counting and occurrence lookup each touch one place per plane, through ones counted before every block; blocks
are compressed one by one, so a lookup unpacks a block per plane and never the file.

Layout, little-endian: magic, then u64 n, levels, documents; per level u64 zeros; per level and block u64 ones before
the level's block, u32 stored bytes; u64 bytes of the document table; the table (zstd: i64 ids, u8 known, u64 tokens);
the blocks in order, each a flag byte (0 as it is, 1 zstd) and its bytes.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WAVELET1"
BLOCK = 1 << 16  # bits of a block


def write(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """The file of `ids`, the tokens of the documents one after the other, `counts[i]` of them for `doc_ids[i]`."""
    levels = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    packer = zstandard.ZstdCompressor(level=1)
    sequence = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    split, times = np.empty_like(sequence), np.bincount(sequence)
    zeros, befores, sizes, blocks = [], [], [], []
    for level in range(levels - 1, -1, -1):
        bit = np.array(1 << level, sequence.dtype)
        zeros.append(int(times[np.arange(len(times)) >> level & 1 == 0].sum()))
        zero, one = 0, zeros[-1]
        for at in range(0, len(sequence), BLOCK):  # a block at a time, which stays in the processor's cache
            here = sequence[at:at + BLOCK]
            ones = (here & bit) != 0
            plain = np.packbits(ones, bitorder="little").tobytes()
            small = packer.compress(plain)
            blocks.append(b"\1" + small if len(small) < len(plain) else b"\0" + plain)
            befores.append(one - zeros[-1])
            sizes.append(len(blocks[-1]))
            places = np.flatnonzero(~ones)  # by places, which is quicker than by a mask
            here.take(places, out=split[zero:zero + len(places)], mode="clip")
            zero, places = zero + len(places), np.flatnonzero(ones)
            here.take(places, out=split[one:one + len(places)], mode="clip")
            one += len(places)
        sequence, split = split, sequence
    table = packer.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes()
                            + np.array([d is not None for d in doc_ids], "u1").tobytes() + np.array(counts, "<u8").tobytes())
    return b"".join([MAGIC, struct.pack("<QQQ", len(ids), levels, len(doc_ids)), np.array(zeros, "<u8").tobytes(),
                     np.array(befores, "<u8").tobytes(), np.array(sizes, "<u4").tobytes(), struct.pack("<Q", len(table)),
                     table, *blocks])


class WaveletFile:
    """Reads one file; `data` may be bytes or a memory map."""

    def __init__(self, data: bytes):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a wavelet file")
        self._data = data
        self.n, self.levels, self.documents = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self._zeros = [int(z) for z in np.frombuffer(data, "<u8", self.levels, at)]
        at += 8 * self.levels
        self._per_level = -(-self.n // BLOCK)
        total = self._per_level * self.levels
        self._before = np.frombuffer(data, "<u8", total, at)
        at += 8 * total
        sizes = np.frombuffer(data, "<u4", total, at)
        at += 4 * total
        (table,) = struct.unpack_from("<Q", data, at)
        self._table = (at + 8, table)
        self._starts = at + 8 + table + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self._block = lru_cache(maxsize=4 * self.levels)(self._read_block)

    def _read_block(self, number: int) -> np.ndarray:
        data = self._data[int(self._starts[number]):int(self._starts[number + 1])]
        plain = zstandard.ZstdDecompressor().decompress(data[1:]) if data[0] else data[1:]
        return np.frombuffer(plain, np.uint8)

    def _ones(self, level: int, position: int) -> int:
        """Ones before a position of a plane."""
        block, inside = divmod(position, BLOCK)
        if block >= self._per_level:
            return self.n - self._zeros[level]
        bits = self._block(level * self._per_level + block)
        ones = int(self._before[level * self._per_level + block]) + int(np.bitwise_count(bits[:inside >> 3]).sum())
        return ones + (int(bits[inside >> 3]) & (1 << (inside & 7)) - 1).bit_count() if inside & 7 else ones

    def _bit(self, level: int, position: int) -> int:
        block, inside = divmod(position, BLOCK)
        return int(self._block(level * self._per_level + block)[inside >> 3]) >> (inside & 7) & 1

    def access(self, position: int) -> int:
        """The token at a position of the file."""
        if not 0 <= position < self.n:
            raise IndexError(position)
        token = 0
        for level in range(self.levels):
            bit = self._bit(level, position)
            ones = self._ones(level, position)
            position = self._zeros[level] + ones if bit else position - ones
            token = token << 1 | bit
        return token

    def _span(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for level in range(self.levels):
            before, until = self._ones(level, begin), self._ones(level, end)
            if token >> (self.levels - 1 - level) & 1:
                begin, end = self._zeros[level] + before, self._zeros[level] + until
            else:
                begin, end = begin - before, end - until
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often a token stands in [begin, end)."""
        if token >> self.levels:
            return 0
        first, last = self._span(token, begin, self.n if end is None else end)
        return last - first

    def locate(self, token: int, k: int) -> int:
        """The position of the k-th occurrence of a token, from 0."""
        if token >> self.levels or not 0 <= k < self.count(token):
            raise IndexError(k)
        position = self._span(token, 0, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            position = self._select(level, one, position - self._zeros[level] if one else position)
        return position

    def _select(self, level: int, one: int, k: int) -> int:
        """The position of the k-th one (or zero) of a plane: the block by bisection, then inside it."""
        first = level * self._per_level
        ones = self._before[first:first + self._per_level].astype(np.int64)
        before = ones if one else np.arange(self._per_level, dtype=np.int64) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(first + block), bitorder="little")[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def tokens(self) -> np.ndarray:
        """All ids in order: the stable splits undone from the last plane up."""
        ids = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        above = np.empty_like(ids)
        for level in range(self.levels - 1, -1, -1):
            zero, one = 0, self._zeros[level]
            bit = np.array(1 << self.levels - 1 - level, ids.dtype)
            for block in range(self._per_level):  # a block at a time, whose places stay in the processor's cache
                here = above[block * BLOCK:(block + 1) * BLOCK]
                ones = np.unpackbits(self._read_block(level * self._per_level + block), count=len(here), bitorder="little").view(bool)
                places = np.flatnonzero(~ones)
                here[places] = ids[zero:zero + len(places)]
                zero, places = zero + len(places), np.flatnonzero(ones)
                here[places] = ids[one:one + len(places)] | bit
                one += len(places)
            ids, above = above, ids
        return ids.astype(np.uint32)

    def table(self) -> tuple[list[int | None], np.ndarray]:
        """The documents in order and their numbers of tokens."""
        at, size = self._table
        plain = zstandard.ZstdDecompressor().decompress(self._data[at:at + size])
        known = np.frombuffer(plain, "u1", self.documents, 8 * self.documents)
        ids = np.frombuffer(plain, "<i8", self.documents)
        return [int(d) if k else None for d, k in zip(ids, known)], np.frombuffer(plain, "<u8", self.documents, 9 * self.documents)
