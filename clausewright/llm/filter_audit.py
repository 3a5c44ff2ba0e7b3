"""Interaction of text filters, from a packed bitmap index.

1. A scan of the whole texts says which of the filters A to D a document fails, and gives a SHA-256 of its text.  E (a copy of a
   smaller doc_id's text) compares the doc_id with the least one of its text.  Texts that over 1 / 4096 of all rows share are at
   most 4096, so their least ids are broadcast; the rest meet in a shuffled join, at most that share of the rows a text.
2. Where the rows stand, each partition packs them into bitsets: one a filter, one a label, and the rows of a part fill words of
   their own, so that a part is a range of words.
3. For each of the 32 prefix subsets of the filters, AND-NOT and popcount give the rows that pass it, also by label; the counts
   of the partitions are summed.  All that an order of filters reports is a difference of two such counts.

Memory: one Arrow batch of short rows a task.  Rows to the sums: 32 a part and batch, combined before they are shuffled.

Defined results: null texts are empty (they fail A, and are copies of each other); null sources are the part ``''``; a null doc_id
has no label, and no other row's doc_id is smaller; rows of one doc_id and one text are not copies by that; of several labels of one
doc_id, 1 counts; an empty table gives no row.  Only doc_id, text, source, quality and toxic are read, whatever else there is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .storage import map_arrow, settle

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
#: A text that more than one row in so many holds is looked up in a broadcast table, which has no more entries than this.
HOT_SHARE = 4096
_SUBSETS = 1 << len(FILTERS)
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_BITS = ("good", "toxic", *FILTERS)
_INDEX = "part string, n int, words int, " + ", ".join(f"{b} binary" for b in _BITS)


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are true."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in ta.pieces(batch.column("text")):
            chars, capitals, marks = _within((data & 0xC0) != 0x80, offsets), _within((data >= 65) & (data <= 90), offsets), _within(_MARK[data], offsets)
            fails, digests = (100 * capitals > CAPITAL_PERCENT * chars) * 4 + (marks > 0) * 8, []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                raw = data[a:b].tobytes()
                words = raw.split()
                fails[i] += (len(words) < LEAST_WORDS) + 2 * (100 * len(set(words)) < DISTINCT_PERCENT * len(words))
                digests.append(hashlib.sha256(raw).digest())
            span = slice(low, high)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[span], batch.column("part")[span], pa.array(digests, pa.binary()), pa.array(fails.astype(np.int32))], ["doc_id", "part", "digest", "fails"])


def _marked_copies(rows: DataFrame, hot_share: int) -> DataFrame:
    """``rows`` with bit E in ``fails``."""
    total = rows.count()
    copies = settle(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "copies")
    hot = F.broadcast(copies.where(F.col("n") * hot_share > total).select("digest", "least"))  # fewer than hot_share rows
    cold = copies.where(F.col("n") * hot_share <= total).select("digest", "least")
    held = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest", "left"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return held.select("doc_id", "part", (F.col("fails") + F.when(later, 16).otherwise(0)).alias("fails"))


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with booleans good and toxic."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    bits = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    nameless = rows.where("doc_id is null").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return rows.where("doc_id is not null").join(known, "doc_id", "left").select("part", "fails", *bits).unionByName(nameless)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part").dictionary_encode()
        codes = parts.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        sizes = np.bincount(codes, minlength=len(parts.dictionary))
        words = -(-sizes // 64)
        begun = np.cumsum(words) - words  # each part starts a word
        at = np.repeat(64 * begun - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(order))
        fails = batch.column("fails").to_numpy()[order]
        flags = {c: batch.column(c).to_numpy(zero_copy_only=False)[order] for c in ("good", "toxic")} | {f: fails >> k & 1 for k, f in enumerate(FILTERS)}
        columns = []
        for name in _BITS:
            bits = np.zeros(64 * int(words.sum()), np.uint8)
            bits[at] = flags[name]
            packed = np.packbits(bits, bitorder="little").tobytes()
            columns.append(pa.array([packed[8 * a : 8 * (a + w)] for a, w in zip(begun.tolist(), words.tolist())], pa.binary()))
        yield pa.RecordBatch.from_arrays([parts.dictionary, pa.array(sizes.astype(np.int32)), pa.array(words.astype(np.int32)), *columns], ["part", "n", "words", *_BITS])


def bitmap_index(docs: DataFrame, labels: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """part, n, words and a bitset (little-endian, whole 64-bit words) of n rows for each label and filter (set: the row fails)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    rows = settle(map_arrow(read, _scan, "doc_id long, part string, digest binary, fails int"), "failures")
    return map_arrow(_with_labels(_marked_copies(rows, hot_share), labels), _pack, _INDEX)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n, words = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "words"))
        begun = np.cumsum(words) - words
        bits = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8") for c in _BITS}
        rows = np.full(int(words.sum()), ~np.uint64(0))  # bits that stand for a row
        spare = 64 * words - n
        rows[begun + words - 1] >>= spare.astype(np.uint64)
        passing = [rows]
        for subset in range(1, _SUBSETS):
            top = subset.bit_length() - 1
            passing.append(passing[subset - (1 << top)] & ~bits[FILTERS[top]])
        counts = lambda sets: np.concatenate([np.add.reduceat(np.bitwise_count(s).astype(np.int64), begun) for s in sets])
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch.column("part")] * _SUBSETS),
                pa.array(np.repeat(np.arange(_SUBSETS, dtype=np.int32), len(n))),
                *(pa.array(counts(s)) for s in (passing, [p & bits["good"] for p in passing], [p & bits["toxic"] for p in passing])),
            ],
            ["part", "subset", "kept", "good", "toxic"],
        )


def prefix_counts(index: DataFrame) -> DataFrame:
    """part, subset (bit k: the k-th filter is in it), kept, good, toxic: rows that pass every filter of the subset."""
    counts = map_arrow(index, _count, "part string, subset int, kept long, good long, toxic long")
    return counts.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def _orders(counts: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, for each part; 32 counts a part meet in one row."""
    whole = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("_c"))
    kept = lambda s: F.get("_c", F.lit(s) if isinstance(s, int) else s)["kept"]
    weight = (24, 6, 4, 6, 24)  # orders in which a prefix of that size stands before the filter

    def shapley(k: int) -> Column:
        return sum((F.lit(weight[s.bit_count()]) * (kept(s) - kept(s | 1 << k)) for s in range(_SUBSETS) if not s >> k & 1), F.lit(0))

    names = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    whole = whole.withColumn("_shapley", F.array(*[shapley(k) for k in range(len(FILTERS))])).withColumn("filter_order", F.explode(names))
    steps = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = sum((F.when(F.instr(F.col("filter_order"), f).between(1, F.col("step") - 1), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    which = F.instr(F.lit(FILTERS), F.substr(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    steps = steps.withColumn("_k", which).withColumn("_s", before).withColumn("_bit", F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), F.col("_k") + 1))
    steps = steps.withColumn("_t", F.col("_s").bitwiseOR(F.col("_bit")))
    lost = lambda c: F.get("_c", F.col("_s"))[c] - F.get("_c", F.col("_t"))[c]
    others = F.lit(_SUBSETS - 1) - F.col("_bit")
    return steps.select(
        "part",
        "filter_order",
        "step",
        kept(F.col("_t")).alias("kept"),
        lost("kept").alias("removed"),
        (kept(0) - kept(F.col("_bit")) - lost("kept")).alias("redundant"),
        (kept(others) - kept(_SUBSETS - 1)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("_shapley", F.col("_k")).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for every order of the filters."""
    return _orders(prefix_counts(bitmap_index(docs, labels)))
