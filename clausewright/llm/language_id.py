"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds all languages: a slot is a bitmask with one bit a language, and the AND of an
n-gram's slots names every language that contains it.  A text's n-grams are looked up all at once; the
popcount of each bit, corrected by that bit's false-positive rate, estimates the share of the text's n-grams
that the language knows, and the largest share decides.

Fitting uses at most ``sample`` labelled documents (those of the least hashed ids; a documented bound) and, so that
rare languages are learned at every size, the ``floor`` least hashed ones of each language, counted by Spark; an
n-gram enters a language's filter if its rate there is at least ``dominance`` of its highest rate in any language and
``least`` texts of the language have it.  The filter has a fixed number of slots, so what goes to the executors is
bounded.

Defined results: a null text, or one without a letter (by Unicode, in every plane), is ``und`` with score 0, as is
every text if no labelled row exists; ties go to the language with more labelled rows, then to the smaller name;
labels that are null don't train, and rows of one doc_id train as one (its least text).  Texts are read whole, however
long, a bounded piece of rows at a time; each row, repeated ones too, gets its own result.  Columns of the input that
are called like a result's give way to it.  lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .sampling import least_hashed
from .storage import forget, map_arrow, settle_at

SAMPLE_ROWS, SLOT_BITS, HASHES = 8_000, 20, 3
#: Rows of each language that are drawn whatever the others have.
LANGUAGE_ROWS = 200
_SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
_table: list[np.ndarray] = []


def _letter(cp: int) -> int:
    """The lower-case letter of a code point, or 32 if it is no letter."""
    c = chr(cp)
    return ord(c.lower()[0]) if c.isalpha() else 32


def folded(points: np.ndarray) -> np.ndarray:
    """Each code point's lower-case letter, or 32 for anything else: the first plane by a table, of the others the
    distinct ones that occur."""
    if not _table:
        _table.append(np.array([_letter(cp) for cp in range(1 << 16)], np.uint32))
    out = _table[0][np.minimum(points, (1 << 16) - 1)]
    wide = np.flatnonzero(points >= 1 << 16)
    if len(wide):
        met, which = np.unique(points[wide], return_inverse=True)
        out[wide] = np.array([_letter(cp) for cp in met.tolist()], np.uint32)[which]
    return out


def grams(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, n-gram hashes, row of each, letters of each row): three- and four-letter sequences of the
    lower-cased text, everything but letters taken as one space, with a space at both ends."""
    for low, high, data, offsets in ta.pieces(col):
        rows = high - low
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        owner = np.repeat(np.arange(rows), np.diff(lead[offsets]))
        points = folded(points)
        letters = np.bincount(owner, weights=points != 32, minlength=rows).astype(np.int64)
        # a space before each row and one after the last
        edges = np.searchsorted(owner, np.arange(rows))
        points = np.insert(points, edges, 32)
        owner = np.insert(owner, edges, np.arange(rows))
        points, owner = np.append(points, np.uint32(32)), np.append(owner, rows)
        keep = (points != 32) | np.concatenate([[True], (points[1:] != points[:-1]) | (points[:-1] != 32) | (owner[1:] != owner[:-1])])
        points, owner = points[keep].astype(np.uint64), owner[keep]
        # the next row's first space also ends this row
        found, rows_of = [], []
        for n in (3, 4):
            if len(points) < n:
                continue
            m = len(points) - n + 1
            h = points[:m].copy()
            for k in range(1, n):
                h = h * np.uint64(1 << 21 | 1) + points[k : m + k]
            last = owner[n - 1 :]
            good = (owner[:m] == last) | ((owner[:m] == owner[n - 2 : n - 2 + m]) & (points[n - 1 :] == 32))
            if n == 3:
                good &= ~((points[:m] == 32) & (points[2 : m + 2] == 32) & (points[1 : m + 1] == 32))
            good &= owner[:m] < rows
            found.append(ta.mix(h[good] + np.uint64(n)))
            rows_of.append(owner[:m][good])
        hashes, rows_at = np.concatenate(found or [np.zeros(0, np.uint64)]), np.concatenate(rows_of or [np.zeros(0, np.int64)])
        yield low, rows, hashes, rows_at, letters


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((hashes * np.uint64(s)) >> np.uint64(64 - bits)).astype(np.int64) for s in _SEEDS[:HASHES]]


class Filter:
    """The bit-sliced filter: ``planes[w][slot]`` has the bits of languages 64 w .. 64 w + 63."""

    def __init__(self, languages: list[str], planes: np.ndarray, bits: int):
        self.languages, self.planes, self.bits = languages, planes, bits
        fills = [((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
        self.false = np.minimum(np.array(fills) ** HASHES, 0.99)

    def shares(self, hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """(rows, languages): the corrected share of each row's n-grams that a language has."""
        slots = _slots(hashes, self.bits)
        total = np.maximum(np.bincount(row, minlength=rows), 1)
        out = np.zeros((rows, len(self.languages)))
        for w in range(len(self.planes)):
            mask = self.planes[w][slots[0]]
            for s in slots[1:]:
                mask &= self.planes[w][s]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits = np.bincount(row[((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)], minlength=rows)
                out[:, i] = np.clip((hits / total - self.false[i]) / (1 - self.false[i]), 0, 1)
        return out


def fit(labelled: DataFrame, sample: int = SAMPLE_ROWS, least: int = 2, dominance: float = 0.2, bits: int = SLOT_BITS, floor: int = LANGUAGE_ROWS) -> Filter | None:
    """A filter from the columns doc_id, text, lang of ``labelled``; None if nothing is labelled."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    path = settle_at(rows.select("doc_id", "lang"), "labelled")  # texts are read once for this, not at each step
    known = rows.sparkSession.read.schema(rows.select("doc_id", "lang").schema).parquet(path)
    each = least_hashed(known, floor, "lang")
    ids = F.broadcast(least_hashed(known, sample).union(each).select("doc_id").distinct())  # at most `sample` numbers, and `floor` a language
    chosen = rows.join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.*")
    counted = chosen.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = [r["lang"] for r in counted]
    if not languages:
        forget(rows.sparkSession, path)
        return None
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for low, rows_here, hashes, row, _ in grams(batch.column("text")):
                order = np.argsort(hashes, kind="stable")  # rows ascend within a hash
                hashes, row = hashes[order], row[order]
                new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
                hashes, lang = hashes[new].view(np.int64), langs[low + row[new]]
                for i in np.unique(lang).tolist():
                    mine = hashes[lang == i]
                    heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                    n = np.diff(np.concatenate([heads, [len(mine)]]))
                    yield pa.RecordBatch.from_arrays([pa.array(mine[heads]), pa.array(np.full(len(n), i)), pa.array(n.astype(np.int64))], ["gram", "lang", "n"])

    per = map_arrow(chosen, count, "gram long, lang long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    texts = F.create_map(*[F.lit(x) for i, r in enumerate(counted) for x in (i, float(r["n"]))])
    rated = per.withColumn("rate", F.col("n") / texts[F.col("lang")])
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "n", "rate")).alias("per"))
    kept = best.select("gram", F.explode("per").alias("p"), "best").where((F.col("p.n") >= least) & (F.col("p.rate") >= dominance * F.col("best"))).select("gram", F.col("p.lang").alias("lang"))
    words = (len(languages) + 63) // 64

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.zeros((words, 1 << bits), np.uint64)
        for batch in batches:
            lang = batch.column("lang").to_numpy()
            for s in _slots(batch.column("gram").to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(planes, (lang // 64, s), np.uint64(1) << (lang % 64).astype(np.uint64))
        for w in range(words):
            at = np.flatnonzero(planes[w])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w)), pa.array(at), pa.array(planes[w][at].astype(np.int64))], ["word", "slot", "mask"])

    filled = map_arrow(kept, fill, "word long, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    planes = np.zeros((words, 1 << bits), np.uint64)
    got = filled.toPandas()  # at most one row a slot
    forget(rows.sparkSession, path)
    planes[got["word"].to_numpy(np.int64), got["slot"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).astype(np.uint64)
    return Filter(languages, planes, bits)


def predict(docs: DataFrame, model: Filter | None) -> DataFrame:
    """``docs`` with lang_pred, score (the share of the best among all shares) and known (the best share)."""
    docs = docs.drop("lang_pred", "score", "known")
    names = [f.name for f in docs.schema]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            langs, scores, knowns = [], [], []
            for _, rows, hashes, row, letters in grams(batch.column("text")):
                if m is None:
                    langs += ["und"] * rows
                    scores.append(np.zeros(rows)), knowns.append(np.zeros(rows))
                    continue
                share = m.shares(hashes, row, rows)
                best, total = share.argmax(1), share.sum(1)
                top = share[np.arange(rows), best]
                none = letters == 0
                langs += ["und" if n else m.languages[b] for n, b in zip(none, best)]
                scores.append(np.where(none, 0.0, np.where(total > 0, top / np.maximum(total, 1e-12), 1 / len(m.languages))))
                knowns.append(np.where(none, 0.0, top))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(langs, pa.string()), cat(scores), cat(knowns)], [*names, "lang_pred", "score", "known"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])
    return map_arrow(docs, run, schema)


def drop_unknown(docs: DataFrame, model: Filter | None, least: float) -> DataFrame:
    """The rows of ``docs`` whose text has letters and whose best language knows at least ``least`` of its n-grams;
    columns unchanged.  Without a model, the rows whose text has letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            keep = []
            for _, rows, hashes, row, letters in grams(batch.column("text")):
                good = letters > 0
                if m is not None:
                    good &= m.shares(hashes, row, rows).max(1) >= least
                keep.append(good)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return map_arrow(docs, run, docs.schema)
