"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the text; where it hits the block size, a chunk ends.  Each
chunk gives one character, so a fingerprint ``block:signature:signature-at-double-block`` is short, and an
edit changes only the chunks that it touches.  The block size starts at a size that suits the length and is
halved until the signature has at least 32 characters.  Fingerprints compare at equal or doubled block sizes
by edit distance (an exchange counts as a removal and an insertion), scaled to 0..1.

Defined results: a null or empty text has the fingerprint ``3::``; two empty fingerprints are alike
(1.0), an empty and another are not (0.0); equal texts have equal fingerprints.  "Next" goes by (doc_id,
text), null doc_ids first, from the last to the first; a single document is its own next, and repeated rows are
documents of their own.  Texts are read whole, however long; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow, settle
from .textarrays import mix

LEAST_BLOCK, LONGEST = 3, 64
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_WINDOW, _FACTOR = 7, 0x01000193
#: Characters of a text that deal rows of one doc_id to ranges.
_DEALT_BY = 64


def _signature(roll: np.ndarray, steps: np.ndarray, block: int) -> bytes:
    ends = np.flatnonzero(roll % np.uint32(block) == block - 1)
    if len(ends) >= LONGEST:
        ends = ends[: LONGEST - 1]
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(roll)]
    if not len(starts):
        return b""
    chunks = np.add.reduceat(steps, starts)
    return _LETTERS[(mix(chunks) >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at double block`` of a UTF-8 text."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    if not len(raw):
        return f"{LEAST_BLOCK}::"
    roll = raw + np.uint32(1)
    value = roll.copy()
    for back in range(1, min(_WINDOW, len(raw))):
        value[back:] += roll[:-back] * np.uint32(pow(_FACTOR, back, 1 << 32))
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value ^= value >> np.uint32(12)
    steps = mix(value.astype(np.uint64) + np.uint64(1))
    block = LEAST_BLOCK
    while block * LONGEST < len(raw):
        block *= 2
    while True:
        one = _signature(value, steps, block)
        if block <= LEAST_BLOCK or len(one) >= LONGEST // 2:
            break
        block //= 2
    return f"{block}:{one.decode()}:{_signature(value, steps, block * 2).decode()}"


def _common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures, by bits of one machine word a pair."""
    n = len(a)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    width_a, width_b = max(map(len, a)), max(map(len, b))
    if not width_a or not width_b:
        return out
    left = np.frombuffer(b"".join(x.ljust(width_a, b"\0") for x in a), np.uint8).reshape(n, width_a)
    right = np.frombuffer(b"".join(x.ljust(width_b, b"\1") for x in b), np.uint8).reshape(n, width_b)
    masks = np.zeros((n, 128), np.uint64)
    rows = np.arange(n)
    for k in range(width_a):
        masks[rows, left[:, k]] |= np.uint64(1 << k)
    masks[:, 0] = masks[:, 1] = 0
    state = np.full(n, np.uint64(2**64 - 1))
    for k in range(width_b):
        met = masks[rows, right[:, k]]
        both = state & met
        state = (state + both) | (state - both)
    return np.bitwise_count(~state).astype(np.int64)


def likeness(first: list[str], second: list[str]) -> np.ndarray:
    """0..1 for each pair of fingerprints: the best of the signatures at equal block sizes."""
    x = [(int(f.split(":")[0]), *(s.encode() for s in f.split(":")[1:])) for f in first]
    y = [(int(f.split(":")[0]), *(s.encode() for s in f.split(":")[1:])) for f in second]
    pairs: list[tuple[int, bytes, bytes]] = []
    for i, ((p, a, aa), (q, b, bb)) in enumerate(zip(x, y)):
        if p == q:
            pairs += [(i, a, b), (i, aa, bb)]
        elif p == 2 * q:
            pairs.append((i, a, bb))
        elif q == 2 * p:
            pairs.append((i, aa, b))
    out = np.array([float(f == g) for f, g in zip(first, second)])
    if pairs:
        owner, a, b = zip(*pairs)
        total = np.array([len(s) + len(t) for s, t in zip(a, b)], float)
        score = np.where(total > 0, 2 * _common(list(a), list(b)) / np.maximum(total, 1), 0.0)
        np.maximum.at(out, np.array(owner), score)
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next document's."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _compared(rows: list[tuple[int | None, str, str, str, str]]) -> list[pa.Array]:
    """Columns of _FOUND for (doc_id, text, fingerprint, next text, next fingerprint)."""
    texts = [edited(text, following).encode() for _, text, _, following, _ in rows]
    own, then, changed = [r[2] for r in rows], [r[4] for r in rows], [fingerprint(t) for t in texts]
    sums = [hashlib.sha256(t).hexdigest() for t in texts]
    return [pa.array(c, t) for c, t in zip(([r[0] for r in rows], [len(r[1]) for r in rows], sums, own, changed, likeness(own, changed), likeness(own, then)), _TYPES)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The documents are dealt by ranges of (doc_id, begin of the text), so that one doc_id of very many rows, or rows
    without one, spread over tasks too; inside a range each document meets its next.  The last one of a range meets
    the first of the following range in a join of one row a range."""
    spark = docs.sparkSession
    key, text = F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, key, F.substring("text", 1, _DEALT_BY)).sortWithinPartitions(key, "text")
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, str] | None = None  # doc_id, text, fingerprint of the document that waits for its next
        out: list[tuple[int | None, str, str, str, str]] = []
        part, size = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            cols = _compared(out)
            none = pa.nulls(len(out), pa.string())
            out.clear()
            return pa.RecordBatch.from_arrays([*cols, none, pa.nulls(len(none), pa.int32()), none], [*names, "side", "part", "text"])

        def end(side: str, row: tuple[int | None, str, str]) -> pa.RecordBatch:
            cols = [pa.array([row[0]], pa.int64()), *[pa.nulls(1, t) for t in _TYPES[1:3]], pa.array([row[2]]), *[pa.nulls(1, t) for t in _TYPES[4:]]]
            return pa.RecordBatch.from_arrays([*cols, pa.array([side]), pa.array([part], pa.int32()), pa.array([row[1]])], [*names, "side", "part", "text"])

        for batch in batches:
            for doc_id, whole in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                now = (doc_id, whole, fingerprint(whole.encode()))
                if held is None:
                    yield end("first", now)
                else:
                    out.append((*held, now[1], now[2]))
                    size += len(whole)
                held = now
                if len(out) >= 1000 or size > 1 << 22:
                    yield flush()
                    size = 0
        if out:
            yield flush()
        if held is not None:
            yield end("last", held)

    found = settle(map_arrow(dealt, run, f"{_FOUND}, side string, part int, text string"), "fingerprints")
    parts = sorted(r["part"] for r in found.where("side = 'first'").select("part").collect())  # one number a range
    order = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, then int")
    firsts = found.where("side = 'first'").select(F.col("part").alias("then"), F.col("text").alias("following"), F.col("fingerprint").alias("theirs")).hint("shuffle_hash")
    met = found.where("side = 'last'").select("part", "doc_id", "text", "fingerprint").join(order, "part").join(firsts, "then")

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "following", "theirs"))))
                yield pa.RecordBatch.from_arrays(_compared(rows), names)

    return found.where("side is null").select(*names).union(map_arrow(met.select("doc_id", "text", "fingerprint", "following", "theirs"), seams, _FOUND))
