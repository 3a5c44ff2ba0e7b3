"""Packing into fixed windows by minimum bin slack.

A document longer than the window is cut into whole windows and a rest.  What is left to pack is then a
multiset of at most ``window - 1`` different lengths, however many documents there are.  The plan is
made on that histogram alone: a bitset subset-sum (bit s of a Python integer: sum s can be reached),
built up length by length with counts, finds the fill closest to the window that holds the longest
remaining length; backtracking gives how many pieces of each length it takes.  The same filling serves
as many windows as the counts allow, so each filling uses up a length and there are few fillings.

Pieces find their place by rank: rank inside its length, in order of (task, row), tells the filling, the
window and the slot.  Ranks need per-task counts only; nothing gathers documents in one place.

Defined results: null texts are empty documents (one end id); null doc_ids and repeated rows are packed
like any others; an empty table gives no row.  Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import map_arrow, settle
from .wordbpe import encoder, slices

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, ord long"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """Counts of lengths, the longest at least once, whose sum comes closest to ``window`` from below.

    Lengths go in from long to short; before each the bitset is kept, and going back through them, each
    length is taken as often as the sum needs, fewest first, so short pieces stay for later windows.
    """
    lengths = sorted(counts, reverse=True)
    first, room = lengths[0], window - lengths[0]
    mask, reach, kept = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left = min(counts[length] - (length == first), room // length)
        kept.append(reach)
        step = 1
        while left > 0 and not reach >> room & 1:  # binary counts; a full window ends the search
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = defaultdict(int, {first: 1})
    for length, before in zip(reversed(lengths[: len(kept)]), reversed(kept)):
        while not before >> total & 1:
            total -= length
            used[length] += 1
    return dict(used)


def plan_fillings(histogram: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(filling, windows that have it), until no length is left."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        used = closest_fill(left, window)
        times = min(left[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


class Places:
    """Window and offset of the r-th piece of a length."""

    def __init__(self, histogram: dict[int, int], window: int):
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        taken, sequence = defaultdict(int), 0
        for used, times in plan_fillings(histogram, window):
            offset = 0
            for length, n in sorted(used.items(), reverse=True):
                rows[length].append((taken[length], n, sequence, offset))
                taken[length] += n * times
                offset += n * length
            sequence += times
        self.rows = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            n = int(length[at[0]])
            base, each, first, shift = self.rows[n]
            k = np.searchsorted(base, rank[at], side="right") - 1
            inside = rank[at] - base[k]
            sequence[at] = first[k] + inside // each[k]
            offset[at] = shift[k] + inside % each[k] * n
        return sequence, offset


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Pieces of each document, with the task that made them and their rank in it among its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, seen = TaskContext.get().partitionId(), encoder(tokenizer), defaultdict(int)
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for low, high in slices(texts):
                out = []
                for doc_id, got in zip(doc_ids[low:high], encode(texts[low:high])):
                    ids = np.append(got, got.dtype.type(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        out.append((doc_id, start, len(piece), zlib.crc32(piece), len(ids), part, seen[len(piece)]))
                        seen[len(piece)] += 1
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _PIECES.replace(",", "").split(" ")[::2])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, _PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = settle(cut_documents(docs, tokenizer, end_id, window), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    if not histogram:
        return spark.createDataFrame([], _PACKED)
    places = spark.sparkContext.broadcast(Places(histogram, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            length = col["length"].to_numpy().astype(np.int64)
            sequence, offset = places.value(length, col["rank"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], col["start"], pa.array(length), col["ids_crc32"], col["doc_tokens"], pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("ord"))
    return map_arrow(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"), place, _PACKED)
