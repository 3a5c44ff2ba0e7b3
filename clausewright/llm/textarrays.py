"""Texts as flat numpy arrays.

Arrow hands a batch of strings over as one byte buffer with offsets.  Words, shingles and windows are
computed on that buffer, so there is no Python work per word.  Hashes are 64-bit, put together eight bytes or two
halves at a time by a bijective scrambling, not by a polynomial, so that no arrangement of letters or words makes
them equal by construction; equal hashes count as equal words (the chance that any two of n distinct values meet is
n^2 / 2^65).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time inside an Arrow batch; a longer text is one piece of its own.
PIECE = 1 << 18

_STEP = np.uint64(0xD1342543DE82EF95)
#: The lowest i bytes of a 64-bit value, i = 0 .. 8.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time; what is longer gets a BLAKE2b digest.
_SHORT = 64
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What a worker remembers between the tasks of one stage only; a scan of another stage starts by forgetting it.
CACHES: list[dict] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(col: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; null texts are empty."""
    for cache in CACHES:
        cache.clear()
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the runs of true bytes; no run goes over from one text into the next."""
    first, last = solid.copy(), solid.copy()
    if len(solid):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = offsets[1:-1]
        at = edges[edges < len(solid)]
        first[at] = solid[at]
        before = edges[edges > 0] - 1
        last[before] = solid[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words ``[^\\x20\\x09-\\x0D]+``, and each text's range of words."""
    starts, ends = runs(~_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash of each byte span; ``fold`` takes A-Z as a-z."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _FOLDED[data] if fold else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    sizes = ends - starts
    out = mix(eight[starts] & _LOW[np.minimum(sizes, 8)] ^ sizes.astype(np.uint64) * _STEP)
    left = np.flatnonzero((sizes > 8) & (sizes <= _SHORT))
    at = 8
    while len(left):
        rest = sizes[left] - at
        out[left] = mix(out[left] * _STEP + (eight[starts[left] + at] & _LOW[np.minimum(rest, 8)]))
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values; entry i covers i .. i + width - 1.  Runs of 1, 2, 4, ... values are hashed
    from two halves, and those that add up to ``width`` are put together."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, part, out, done = 1, words, None, 0
    while True:
        if width & have:
            out = part[:n] if out is None else mix(out * _STEP + part[done : done + n])
            done += have
        if done == width:
            return mix(out ^ np.uint64(width))
        part = mix(part[:-have] * _STEP + part[have:])
        have *= 2


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``range(starts[i], starts[i] + counts[i])``."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
