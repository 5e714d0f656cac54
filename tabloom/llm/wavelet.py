"""Wavelet matrix over token ids (Claude, Navarro and Ordonez 2015) in numpy.

Plane by plane, from the highest bit, ids are split into those with a 0 and
those with a 1, each in their order; a plane keeps the bits. ``access``,
``rank`` and ``select`` follow a position through the planes. The file holds the
compressed planes, the ones before each block of 512 bits, and where each
document starts.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WVMX"
BLOCK = 512
_HEAD = struct.Struct("<4sBQQ")


class Plane:
    """Bits with rank and select; ``before`` has the ones before each block."""

    def __init__(self, words: np.ndarray, size: int, before: np.ndarray | None = None) -> None:
        self.words, self.size = words, size
        if before is None:
            per_block = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            before = np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint64)
        self.before = before
        self.zeros = size - int(before[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        room = np.zeros((len(bits) // BLOCK + 1) * (BLOCK // 8), dtype=np.uint8)
        room[: len(packed)] = packed
        return cls(room.view("<u8"), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.size, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at // BLOCK
        inside = (at % BLOCK)[:, None] - 64 * np.arange(BLOCK // 64)[None, :]
        taken = np.clip(inside, 0, 64)
        mask = np.where(taken == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(taken, 63).astype(np.uint64)) - np.uint64(1))
        rows = self.words.reshape(-1, BLOCK // 64)[np.minimum(block, len(self.words) // 8 - 1)]
        return self.before[block].astype(np.int64) + np.bitwise_count(rows & mask).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero; k must be smaller than their number."""
        before = self.before.astype(np.int64)
        if not one:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.size) - before
        block = np.searchsorted(before, k, side="right") - 1
        rows = self.words.reshape(-1, BLOCK // 64)[block].view(np.uint8).reshape(len(k), -1)
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        seen = np.cumsum(bits if one else 1 - bits, axis=1, dtype=np.int64)
        return block * BLOCK + np.argmax(seen > (k - before[block])[:, None], axis=1)


class WaveletMatrix:
    def __init__(self, size: int, planes: list[Plane], doc_ids: np.ndarray, ends: np.ndarray) -> None:
        self.size, self.planes, self.doc_ids, self.ends = size, planes, doc_ids, ends

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> WaveletMatrix:
        planes, row = [], np.asarray(ids)
        for shift in range(int(row.max(initial=0)).bit_length() - 1, -1, -1):
            bits = (row >> row.dtype.type(shift)) & row.dtype.type(1) != 0
            planes.append(Plane.of(bits))
            row = np.concatenate([row[~bits], row[bits]])
        return cls(len(row), planes, np.asarray(doc_ids, dtype="<i8"), np.cumsum(counts).astype("<i8"))

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        row = np.zeros(self.size, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for shift, plane in enumerate(reversed(self.planes)):
            bits, above = plane.bits(), np.empty_like(row)
            above[~bits] = row[: plane.zeros]
            above[bits] = row[plane.zeros :] | row.dtype.type(1 << shift)
            row = above
        return row

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at, out = np.asarray(at, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for plane in self.planes:
            bit, ones = plane.get(at) != 0, plane.rank(at)
            out = out * 2 + bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        edges = np.array([start, end], dtype=np.int64)
        for depth, plane in enumerate(self.planes):
            ones = plane.rank(edges)
            edges = plane.zeros + ones if token >> (len(self.planes) - 1 - depth) & 1 else edges - ones
        return int(edges[0]), int(edges[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs at positions start .. end - 1."""
        first, last = self._range(token, start, self.size if end is None else end)
        return last - first

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of an id, ascending."""
        first, last = self._range(token, 0, self.size)
        at = np.arange(first, last, dtype=np.int64)
        for shift, plane in enumerate(reversed(self.planes)):
            one = bool(token >> shift & 1)
            at = plane.select(at - plane.zeros if one else at, one) if len(at) else at
        return at

    def document(self, k: int) -> np.ndarray:
        start = int(self.ends[k - 1]) if k else 0
        return self.access(np.arange(start, int(self.ends[k])))

    def to_bytes(self, level: int = 1) -> bytes:
        pack = zstandard.ZstdCompressor(level=level).compress
        parts = [self.doc_ids.tobytes(), np.diff(self.ends, prepend=0).astype("<i8").tobytes()]
        for plane in self.planes:
            parts += [plane.words.tobytes(), plane.before.astype("<u8").tobytes()]
        frames = [pack(x) for x in parts]
        sizes = np.array([len(x) for x in frames], dtype="<u8").tobytes()
        return _HEAD.pack(MAGIC, len(self.planes), self.size, len(self.doc_ids)) + sizes + b"".join(frames)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, depth, size, _ = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        sizes = np.frombuffer(data, dtype="<u8", count=2 + 2 * depth, offset=_HEAD.size).astype(np.int64)
        at, frames, unpack = _HEAD.size + 8 * len(sizes), [], zstandard.ZstdDecompressor().decompress
        for n in sizes:
            frames.append(unpack(data[at : at + int(n)]))
            at += int(n)
        whole = [np.frombuffer(x, dtype="<u8") for x in frames[2:]]
        planes = [Plane(whole[2 * k], size, whole[2 * k + 1]) for k in range(depth)]
        return cls(size, planes, np.frombuffer(frames[0], dtype="<i8"), np.cumsum(np.frombuffer(frames[1], dtype="<i8")))
