"""Token-ID files: one wavelet matrix per shard.

A shard holds the ids of consecutive documents.  Its file is the magic word, the length of a JSON head,
the head, and zstd-compressed sections: document ids, document lengths, and for each bit of an id,
highest first, a bit-plane with a count of ones before every block of 512 bits.  At each level the ids
are dealt stably by their bit, zeros first, which makes access, counting (rank) and finding the k-th
occurrence (select) walks over the planes; one file answers all of them.
"""

from __future__ import annotations

import json

import numpy as np

MAGIC, _BLOCK = b"CWWM1\n", 512
#: Ids in a shard, unless one document has more.
SHARD_IDS = 1 << 20


class WaveletMatrix:
    """Token access, rank and select over planes of bits."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ones, self.zeros = n, planes, ones, zeros

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        planes, ones, zeros = [], [], []
        for level in range(max(1, top.bit_length()) - 1, -1, -1):
            bits = (ids >> ids.dtype.type(level)) & ids.dtype.type(1)
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            per_block = np.add.reduceat(bits, np.arange(0, len(bits), _BLOCK), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
            planes.append(packed)
            ones.append(np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32))
            high = bits.astype(bool)
            zeros.append(int(len(ids) - high.sum()))
            ids = np.concatenate([ids[np.flatnonzero(~high)], ids[np.flatnonzero(high)]])  # by place: a mask is slow on mixed bits
        return cls(len(ids), planes, ones, zeros)

    def ids(self) -> np.ndarray:
        """All ids in order: the dealing undone from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level, (packed, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            high = np.unpackbits(packed, count=self.n, bitorder="little").astype(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~high)] = out[:zeros]
            back[np.flatnonzero(high)] = out[zeros:] | kind(1 << level)
            out = back
        return out.astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        block = i // _BLOCK
        part = self.planes[level][block * _BLOCK // 8 : (i + 7) // 8]
        return int(self.ones[level][block]) + int(np.unpackbits(part, bitorder="little")[: i - block * _BLOCK].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            before = self._rank1(level, i)
            i = self.zeros[level] + before if bit else i - before
            value = value * 2 + bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where, below the last plane, the occurrences of ``token`` among the first i ids lie."""
        low = 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, low), self._rank1(level, i)
            if token >> (len(self.planes) - 1 - level) & 1:
                low, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, i = low - a, i - b
        return low, i

    def rank(self, token: int, i: int | None = None) -> int:
        """How often ``token`` occurs among the first i ids (all, if None)."""
        if token < 0 or token >> len(self.planes):
            return 0
        low, high = self._range(token, self.n if i is None else i)
        return high - low

    count = rank

    def _select_bit(self, level: int, k: int, bit: int) -> int:
        ones = self.ones[level].astype(np.int64)
        seen = ones if bit else np.minimum(np.arange(len(ones)) * _BLOCK, self.n) - ones
        block = int(np.searchsorted(seen, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8], bitorder="little")
        part = part[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.flatnonzero(part == bit)[k - seen[block]])

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of ``token``."""
        if k < 0 or k >= self.rank(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self._select_bit(level, i - self.zeros[level] * bit, bit)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]


def dump(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file of one shard."""
    from zstandard import ZstdCompressor

    matrix = WaveletMatrix.of(ids)
    pack = ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    sections = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(lengths, "<i8").tobytes()]
    for plane, ones in zip(matrix.planes, matrix.ones):
        sections += [plane.tobytes(), ones.astype("<u4").tobytes()]
    packed = [pack(s) for s in sections]
    head = json.dumps({"n": matrix.n, "zeros": matrix.zeros, "sizes": [len(p) for p in packed]}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(packed)


def load(content: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, lengths and the matrix of a shard's file."""
    from zstandard import ZstdDecompressor

    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token-ID shard")
    at = len(MAGIC) + 4
    size = int.from_bytes(content[len(MAGIC) : at], "little")
    head = json.loads(content[at : at + size])
    at += size
    unpack, sections = ZstdDecompressor().decompress, []
    for length in head["sizes"]:
        sections.append(unpack(content[at : at + length]))
        at += length
    doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(sections[0], "<i8"), np.frombuffer(sections[1], np.uint8))]
    planes = [np.frombuffer(s, np.uint8) for s in sections[3::2]]
    ones = [np.frombuffer(s, "<u4") for s in sections[4::2]]
    return doc_ids, np.frombuffer(sections[2], "<i8"), WaveletMatrix(head["n"], planes, ones, head["zeros"])
