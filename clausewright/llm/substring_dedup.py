"""Substring dedup: every word that lies in a repeated run of ``width`` words goes.

The de Bruijn graph of the corpus has the windows of ``width`` tokens as edges and the ``width - 1`` tokens that two
windows share as nodes.  A repeated edge is a window whose words start in two places.  The steps:

1. Scan: consecutive windows that share their least 12-word hash (their minimiser) form one path.  Equal
   windows have equal minimisers, so a path goes, as one packed entry with its source coordinates (row keys,
   first word, windows), to the bucket of its minimiser.  Windows that repeat inside the piece of text
   at hand are known to be repeated and go only once, without coordinates: a passage that a third of all
   rows share reaches a bucket once a piece, not once a row.
2. Buckets: edges that occur again are found; runs of repeated edges on one path compact to one span.  A bucket
   is worked off in parts of bounded size: between parts only its distinct edges are kept, each with the
   coordinates of its first occurrence or the note that it is repeated, so copies take no memory.
3. The spans of a row are grouped (equal rows give equal spans, which count once), and a Spark join on the row's
   keys brings them to the text; overlapping and adjacent spans close up into the long repeated passages, in
   source coordinates, across the buckets that their paths went to, and the words they cover are taken out.

An edge is known by two 64-bit hashes, that of its window and that of its minimiser, a row by a 64-bit and a 32-bit
hash of its doc_id and text; the words themselves are not compared again (README).  Defined results: null and empty
texts have no words; texts shorter than a window lose nothing; repeated rows lose what they share with each other;
very long texts are one piece of the scan; only doc_id and text are read (with ``keep_columns`` the other columns of
the row pass through untouched, whatever they are called).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .storage import map_arrow

MINIMISER = 12
#: Bytes of text whose windows are looked at together, and buckets a shuffle partition.
_SCAN, _BUCKETS = 2 << 20, 4
#: Windows of a bucket that are looked at together.
_PART = 1 << 22
_ROWS = "bucket int, keys binary, marks binary, starts binary, counts binary, minimisers binary, hashes binary"
_FIELDS = ["bucket", "keys", "marks", "starts", "counts", "minimisers", "hashes"]
_TYPES = ("<i8", "<i4", "<i4", "<i4", "<u8", "<u8")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def _scan(width: int, buckets: int):
    k = min(MINIMISER, width)

    def row(bucket, *columns):
        return (bucket, *(c.astype(t).tobytes() for c, t in zip(columns, _TYPES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = batch.column("_key").to_numpy(), batch.column("_mark").to_numpy()
            for low, high, data, offsets in ta.pieces(batch.column("text"), _SCAN):
                starts, ends, cuts = ta.word_spans(data, offsets)
                words = ta.span_hashes(data, starts, ends)
                if len(words) < width:
                    continue
                sizes = np.diff(cuts)
                room = np.maximum(sizes - width + 1, 0)
                at = ta.ranges(cuts[:-1], room)  # first words of windows
                if not len(at):
                    continue
                hashes = ta.windows(words, width)[at]
                least = _least(ta.windows(words, k), width - k + 1)[at]
                doc = np.repeat(np.arange(high - low), room)
                del words
                order = np.argsort(hashes, kind="stable")
                ranked = hashes[order]
                fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
                alone = fresh & np.concatenate([fresh[1:], [True]])
                first, single = np.zeros(len(at), bool), np.zeros(len(at), bool)
                first[order], single[order] = fresh, alone
                del order, ranked
                out = []
                # spans known from this piece
                known = np.flatnonzero(~single)
                if len(known):
                    cut = np.concatenate([[True], (np.diff(at[known]) != 1) | (np.diff(doc[known]) != 0)])
                    heads = known[cut]
                    counts = np.diff(np.concatenate([np.flatnonzero(cut), [len(known)]]))
                    out.append(row(-1 - int(hashes[0] % np.uint64(1 << 30)), keys[low + doc[heads]], marks[low + doc[heads]], at[heads] - cuts[doc[heads]], counts, hashes[:0], hashes[:0]))
                # paths: runs of windows of one minimiser, either alone here or met again here
                sent = np.flatnonzero(first)
                mine, which = least[sent], single[sent]
                cut = np.concatenate([[True], (np.diff(at[sent]) != 1) | (np.diff(doc[sent]) != 0) | (mine[1:] != mine[:-1]) | (which[1:] != which[:-1])])
                heads = np.flatnonzero(cut)
                counts = np.diff(np.concatenate([heads, [len(sent)]]))
                bucket = ((ta.mix(mine[heads]) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                heads, counts, bucket = heads[order], counts[order], bucket[order]
                path_keys, path_marks = keys[low + doc[sent[heads]]], marks[low + doc[sent[heads]]]
                path_least = mine[heads]
                path_starts = np.where(which[heads], at[sent[heads]] - cuts[doc[sent[heads]]], -1)
                every = hashes[sent[ta.ranges(heads, counts)]]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                ends_of = np.concatenate([[0], np.cumsum(counts)])
                for a, b in zip(edges[:-1], edges[1:]):
                    out.append(row(int(bucket[a]), path_keys[a:b], path_marks[a:b], path_starts[a:b], counts[a:b], path_least[a:b], every[ends_of[a] : ends_of[b]]))
                for a in range(0, len(out), 256):
                    cols = list(zip(*out[a : a + 256]))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], _FIELDS)

    return run


class Bucket:
    """The paths of a bucket that still matter: keys, marks, starts, counts, minimisers of paths, hashes of windows."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.windows = self.kept = 0

    def add(self, columns: list[bytes]) -> None:
        self.parts.append(tuple(np.frombuffer(c, t) for c, t in zip(columns, _TYPES)))
        self.windows += len(self.parts[-1][-1])

    def full(self) -> bool:
        return self.windows > _PART + 2 * self.kept

    def work_off(self) -> tuple[np.ndarray, ...] | None:
        """Spans (keys, marks, first words, windows) of edges found again; what is kept is each distinct edge once."""
        keys, marks, starts, counts, least, hashes = (np.concatenate(c) for c in zip(*self.parts))
        starts, counts = starts.astype(np.int64), counts.astype(np.int64)
        path = np.repeat(np.arange(len(keys)), counts)
        order = np.argsort(hashes, kind="stable")
        ranked, of = hashes[order], least[path]
        same = ranked[1:] == ranked[:-1]
        if (same & (of[order[1:]] != of[order[:-1]])).any():  # equal window hashes with other minimisers are other edges
            order = np.lexsort((of, hashes))
            ranked = hashes[order]
            same = (ranked[1:] == ranked[:-1]) & (of[order[1:]] == of[order[:-1]])
        again = np.zeros(len(hashes), bool)
        again[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        begun = np.cumsum(counts) - counts
        where = starts[path] + np.arange(len(hashes)) - begun[path]
        known = starts[path] < 0
        # what later parts need: one of each edge, with coordinates as long as it is alone
        first = order[np.concatenate([[True], ~same])] if len(order) else order
        known_edge = np.logical_or.reduceat(known[order], np.flatnonzero(np.concatenate([[True], ~same]))) if len(order) else known
        gone = again[first] | known_edge
        self.parts = [(keys[path[first]], marks[path[first]], np.where(gone, -1, where[first]).astype("<i4"), np.ones(len(first), "<i4"), of[first], hashes[first])]
        self.windows = self.kept = len(first)
        at = np.flatnonzero(again & ~known)
        if not len(at):
            return None
        cut = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(path[at]) != 0)])
        heads = at[cut]
        lengths = np.diff(np.concatenate([np.flatnonzero(cut), [len(at)]]))
        return keys[path[heads]], marks[path[heads]], where[heads], lengths


def _compact(width: int):
    """Buckets to spans (row keys, first word, end word) of repeated windows."""

    def spans(keys, marks, starts, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(marks), pa.array(starts.astype(np.int32)), pa.array((starts + counts + width - 1).astype(np.int32))], ["_key", "_mark", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, Bucket()
        for batch in batches:
            for b, *columns in zip(*(batch.column(c).to_pylist() for c in _FIELDS)):
                if b < 0:
                    keys, marks, starts, counts = (np.frombuffer(c, t) for c, t in zip(columns[:4], _TYPES))
                    yield spans(keys, marks, starts.astype(np.int64), counts.astype(np.int64))
                    continue
                if b != number:
                    found = held.work_off() if held.parts else None
                    if found:
                        yield spans(*found)
                    number, held = b, Bucket()
                held.add(columns)
                if held.full():
                    found = held.work_off()
                    if found:
                        yield spans(*found)
        found = held.work_off() if held.parts else None
        if found:
            yield spans(*found)

    return run


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """(_key, _mark, low, high): word ranges that repeated windows cover.  ``docs`` has _key, _mark and text."""
    buckets = _BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = map_arrow(docs.select("_key", "_mark", "text"), _scan(width, buckets), _ROWS)
    return map_arrow(paths.repartition("bucket").sortWithinPartitions("bucket"), _compact(width), "_key long, _mark int, low int, high int")


def remove_repeated(docs: DataFrame, width: int = 35, keep_columns: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``keep_columns`` the columns of ``docs`` with the text
    cut (one space between kept words; a text that loses nothing stays as it is) and n_chars kept in step."""
    doc_id = F.col("doc_id").cast("long")
    # the input's columns travel as one struct, so that no name of theirs can clash with ours
    row = F.struct(*[F.col(f"`{f.name}`") for f in docs.schema]) if keep_columns else F.struct(doc_id.alias("doc_id"), "text")
    keyed = docs.select(F.xxhash64(doc_id, "text").alias("_key"), F.hash(doc_id, "text").alias("_mark"), row.alias("row"))
    found = repeated_spans(keyed.select("_key", "_mark", F.col("row.text").alias("text")), width)
    # spans of equal rows are equal and count once; (low, high) packed in one number
    packed = F.shiftleft(F.col("low").cast("long"), 32) + F.col("high")
    spans = found.groupBy("_key", "_mark").agg(F.collect_set(packed).alias("_spans"))
    joined = keyed.join(spans.hint("shuffle_hash"), ["_key", "_mark"], "left").select("row", "_spans")
    kept_schema = docs.schema if keep_columns else None
    texts_at = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = batch.column("row").field
            total, gone, digests, texts = [], [], [], []
            for text, pairs in zip(field("text"), batch.column("_spans").to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()
                removed = 0
                if pairs:
                    mark, ends = np.zeros(len(words) + 1, np.int64), np.array(pairs, np.int64)
                    np.add.at(mark, ends >> 32, 1)
                    np.add.at(mark, ends & 0xFFFFFFFF, -1)
                    stay = np.cumsum(mark)[:-1] == 0
                    removed = int(len(words) - stay.sum())
                    words_left = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    words_left = words
                total.append(len(words))
                gone.append(removed)
                joined_words = b" ".join(words_left)
                if keep_columns:
                    texts.append(joined_words.decode() if removed else text.as_py())
                else:
                    digests.append(hashlib.sha256(joined_words).hexdigest())
            n_words, n_removed = pa.array(total, pa.int64()), pa.array(gone, pa.int64())
            if not keep_columns:
                yield pa.RecordBatch.from_arrays([field("doc_id"), n_words, n_removed, pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])
                continue
            cols = {c: field(c) for c in texts_at}
            changed = pa.array(texts, pa.string())
            cols["text"] = changed
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) if t is not None else n for t, n in zip(texts, field("n_chars").to_pylist())], field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    if keep_columns:
        return map_arrow(joined, run, kept_schema)
    return map_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
