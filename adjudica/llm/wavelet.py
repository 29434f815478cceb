"""Wavelet matrix of token ids: one compressed file per shard that answers access, rank, select, count and locate.

File, little-endian: ``MAGIC``; crc32 of the rest; the header's nine unsigned 64-bit numbers (tokens, ids
before the file, documents, planes, bits a block, then the byte lengths of the document table, the rank directory, the block directory and the
data); the document table (zstd: ids as int64, a null flag a document, token ends as int64); the rank directory
(zstd: zeros of each plane, then ones before each block); the block directory (ends of the compressed blocks); the
blocks, zstd each. Plane 0 holds the ids' highest bit; each plane's zeros go before its ones in the next.

A document without tokens or a file without documents is legal. A null document id is kept as null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVM1"
HEADER = "<9Q"
BLOCK_BITS = 1 << 16
LEVEL = 1


def build(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, before: int = 0, block_bits: int = BLOCK_BITS) -> bytes:
    """The file of a shard: ``ids`` of all its documents in order, where each document's ids end, and how many ids
    its writer put into earlier files."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    pack, zeros, ranks, blocks = zstandard.ZstdCompressor(level=LEVEL), [], [], []
    for plane in range(planes):
        bits = (now >> (planes - 1 - plane)) & 1 == 1
        packed = np.packbits(bits, bitorder="little")
        step = block_bits // 8
        ones = 0
        for at in range(0, len(packed), step):
            raw = packed[at : at + step]
            ranks.append(ones)
            ones += int(np.bitwise_count(raw).sum())
            blocks.append(pack.compress(raw.tobytes()))
        zeros.append(len(now) - ones)
        now = np.concatenate([now[~bits], now[bits]])
    table = pack.compress(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + ends.astype("<i8").tobytes()
    )
    rank = pack.compress(np.array(zeros + ranks, "<u8").tobytes())
    where = np.cumsum([len(b) for b in blocks], dtype="<u8").tobytes()
    data = b"".join(blocks)
    rest = struct.pack(HEADER, len(ids), before, len(doc_ids), planes, block_bits, len(table), len(rank), len(where), len(data))
    rest += table + rank + where + data
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


class WaveletMatrix:
    """Reads such a file. Single queries unpack only the blocks that they touch."""

    def __init__(self, file: bytes, check: bool = True):
        if file[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        if check and zlib.crc32(memoryview(file)[8:]) != struct.unpack_from("<I", file, 4)[0]:
            raise ValueError("the file is damaged")
        size = struct.calcsize(HEADER)
        self.n, self.before, self.n_docs, self.planes, self.block_bits, *lengths = struct.unpack_from(HEADER, file, 8)
        at, parts = 8 + size, []
        for length in lengths:
            parts.append(memoryview(file)[at : at + length])
            at += length
        unpack = zstandard.ZstdDecompressor().decompress
        table = unpack(parts[0])
        ids, null = np.frombuffer(table, "<i8", self.n_docs), table[8 * self.n_docs : 9 * self.n_docs]
        self.doc_ids = [None if flag else int(d) for d, flag in zip(ids, null, strict=True)]
        self.ends = np.frombuffer(table, "<i8", self.n_docs, 9 * self.n_docs) if self.n_docs else np.zeros(0, np.int64)
        numbers = np.frombuffer(unpack(parts[1]), "<u8").astype(np.int64)
        self.zeros, self.ranks = numbers[: self.planes], numbers[self.planes :]
        self.where = np.concatenate([[0], np.frombuffer(parts[2], "<u8").astype(np.int64)])
        self.data, self.per_plane = parts[3], -(-self.n // self.block_bits)
        self.block = lru_cache(maxsize=64)(self._block)

    def _block(self, number: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.where[number] : self.where[number + 1]])
        return np.frombuffer(raw, np.uint8)

    def _bit(self, plane: int, at: int) -> int:
        block, bit = divmod(at, self.block_bits)
        return int(self.block(plane * self.per_plane + block)[bit >> 3] >> (bit & 7)) & 1

    def _ones(self, plane: int, at: int) -> int:
        """Ones of the plane before ``at``."""
        if at >= self.n:
            return self.n - int(self.zeros[plane])
        block, bit = divmod(at, self.block_bits)
        number = plane * self.per_plane + block
        raw = self.block(number)
        tail = int(raw[bit >> 3]) & ((1 << (bit & 7)) - 1)
        return int(self.ranks[number]) + int(np.bitwise_count(raw[: bit >> 3]).sum()) + tail.bit_count()

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.planes):
            bit, ones = self._bit(plane, at), self._ones(plane, at)
            value = value << 1 | bit
            at = int(self.zeros[plane]) + ones if bit else at - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences within the range stand below the last plane."""
        if token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._ones(plane, start), self._ones(plane, end)
            if token >> (self.planes - 1 - plane) & 1:
                start, end = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, max(0, start), self.n if end is None else min(end, self.n))
        return max(0, b - a)

    def rank(self, token: int, at: int) -> int:
        """Occurrences before ``at``."""
        return self.count(token, 0, at)

    def select(self, token: int, k: int) -> int:
        """Where the k-th occurrence stands, from 0; -1 if there are fewer."""
        start, end = self._range(token, 0, self.n)
        if not 0 <= k < end - start:
            return -1
        at = start + k
        for plane in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - plane) & 1
            at = self._find(plane, bit, at - int(self.zeros[plane]) if bit else at)
        return at

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Where the k-th such bit of the plane stands."""
        first = plane * self.per_plane
        ones = self.ranks[first : first + self.per_plane]
        before = ones if bit else np.arange(self.per_plane) * self.block_bits - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        left = min(self.block_bits, self.n - block * self.block_bits)
        bits = np.unpackbits(self.block(first + block), bitorder="little")[:left]
        return block * self.block_bits + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def locate(self, token: int) -> Iterator[int]:
        start, end = self._range(token, 0, self.n)
        return (self.select(token, k) for k in range(end - start))

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last: each stable partition is undone."""
        ids = np.zeros(self.n, np.uint32)
        for plane in reversed(range(self.planes)):
            first = plane * self.per_plane
            blocks = [self._block(first + b) for b in range(self.per_plane)]
            bits = np.unpackbits(np.concatenate(blocks), bitorder="little")[: self.n].view(bool) if blocks else np.zeros(0, bool)
            back, zeros = np.empty_like(ids), int(self.zeros[plane])
            back[~bits] = ids[:zeros]
            back[bits] = ids[zeros:] | np.uint32(1 << (self.planes - 1 - plane))
            ids = back
        return ids
