"""Exact top-k by inner product over integer vectors, with multi-resolution segment statistics.

A vector is cut into segments.  With the mean m and the deviation s (root of the mean squared distance from
the mean) of a segment of n components, Cauchy and Schwarz give

    q . x  <=  sum over segments of  n * (m_q * m_x + s_q * s_x)

which is a lower bound of the distance |q|^2 + |x|^2 - 2 q.x; finer segments bound more closely.  Candidates are
looked at in the place where they are scanned, a cell of bounded size at a time; the blocks of queries stream
past each cell from the shared folder (a stated query set against all rows, in blocks).  A cell's candidates
stand in order of length, the longest first, in chunks:

1. A bound of the whole chunk (its largest mean and deviation) throws out the chunk for every query whose k-th
   best score so far is higher.
2. Level by level, the coarsest first, one matrix product bounds the queries and candidates that are left;
   rows and columns without a survivor go before the next level is computed.  Once few pairs are left, levels
   are computed for those pairs alone.
3. Survivors get their exact integer score, and each query's threshold carries on into the next chunk.

Memory: one cell and one block of queries a task; nothing is broadcast or collected.  Rows to the final merge: k a
query and cell.

Defined results: vectors that are null, or hold a null, NaN or infinity, take no part; missing components of
shorter vectors count as 0; an empty vector scores 0 with everything; null ids take no part; of rows with the
same id each is a candidate, and each query row with one id is a query of its own only once (the first by
vector); components and scores beyond 64 bits end at the range's limits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import map_arrow, open_table, settle_at

#: Rows of a query block, candidates of a chunk, candidates that a task holds.
QUERY_ROWS, CHUNK_ROWS, CELL_ROWS = 256, 4096, 1 << 17
SEGMENTS = (1, 4, 16)
#: Below this share of survivors, pairs are looked at one by one.
FEW = 1 / 16
_SAFE = float(2**53)
_BLOCK = "width int, narrow boolean, ids binary, body binary"


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row: sqrt(n) * mean of every segment, then sqrt(n) * deviation of every segment."""
    edges = np.unique(np.linspace(0, x.shape[1], segments + 1).astype(int))
    sizes = np.diff(edges)
    means = np.add.reduceat(x, edges[:-1], axis=1) / sizes
    away = np.add.reduceat((x - np.repeat(means, sizes, axis=1)) ** 2, edges[:-1], axis=1)
    return np.concatenate([means * np.sqrt(sizes), np.sqrt(away)], axis=1)


class Vectors:
    """Rows of vectors with their ids, lengths and statistics of each level (computed when first used)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.norms = np.sqrt((x * x).sum(1))

    @cached_property
    def levels(self) -> list[np.ndarray]:
        kind = np.float32 if self.norms.max(initial=0) < 1e15 else np.float64
        return [_statistics(self.x, s).astype(kind) for s in SEGMENTS if s <= max(1, self.x.shape[1])]

    def chunks(self) -> list[Vectors]:
        order = np.argsort(-self.norms, kind="stable")
        first = min(CHUNK_ROWS // 16, len(order))  # sets the first thresholds
        cuts = [0, first, *range(first + CHUNK_ROWS, len(order), CHUNK_ROWS), len(order)]
        return [Vectors(self.ids[order[a:b]], self.x[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.row, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.kth = np.full(queries, np.iinfo(np.int64).min)
        self.full = np.zeros(queries, bool)

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.kth[row]
        row, ids, scores = (np.concatenate(p) for p in ((self.row, row[good]), (self.ids, ids[good]), (self.scores, scores[good])))
        order = np.lexsort((ids, ~scores, row))  # ~s falls as s rises, without overflow
        row = row[order]
        starts = np.searchsorted(row, row)
        top = np.arange(len(row)) - starts < self.k
        self.row, self.ids, self.scores = row[top], ids[order][top], scores[order][top]
        last = np.flatnonzero(np.arange(len(row))[top] - starts[top] == self.k - 1)
        self.kth[self.row[last]], self.full[self.row[last]] = self.scores[last], True

    def threshold(self) -> np.ndarray:
        return np.where(self.full, self.kth.astype(float), -np.inf)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``q`` with the same rows of ``x``."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < _SAFE:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    totals = [sum(int(a) * int(b) for a, b in zip(r, c)) for r, c in zip(q.tolist(), x.tolist())]
    return np.array([min(max(t, -(2**63)), 2**63 - 1) for t in totals], np.int64)


def look_through(q: Vectors, x: Vectors, best: Best) -> int:
    """Puts the pairs of a block of queries and a chunk of candidates that may be among the best into ``best``; says
    how many pairs needed their exact score."""
    limit = best.threshold()
    slack = 2e-5 * (1 + q.norms * x.norms.max(initial=0))
    floor = limit - slack
    # the whole chunk at the coarsest level
    top = np.abs(x.levels[0]).max(0).astype(float)
    rows = np.flatnonzero(np.abs(q.levels[0]) @ top >= floor)
    cols = np.arange(len(x.ids))
    pairs = None
    for of_q, of_x in zip(q.levels, x.levels):
        if pairs is None:
            if not len(rows) or not len(cols):
                return 0
            alive = of_q[rows] @ of_x[cols].T >= floor[rows, None]
            on_rows, on_cols = alive.any(1), alive.any(0)
            n = int(np.count_nonzero(alive))
            if n < FEW * alive.size:
                r, c = np.nonzero(alive)
                pairs = rows[r], cols[c]
            rows, cols = rows[on_rows], cols[on_cols]
        else:
            r, c = pairs
            keep = np.einsum("ij,ij->i", of_q[r], of_x[c]) >= floor[r]
            pairs = r[keep], c[keep]
    if pairs is None:
        if not len(rows) or not len(cols):
            return 0
        if np.abs(q.x).max(initial=0) * np.abs(x.x).max(initial=0) * q.x.shape[1] < _SAFE:
            scores = q.x[rows] @ x.x[cols].T
            r, c = np.nonzero(scores >= np.maximum(limit[rows], -_SAFE)[:, None])
            own = q.ids[rows[r]] == x.ids[cols[c]]
            r, c = r[~own], c[~own]
            best.add(rows[r], x.ids[cols[c]], scores[r, c].astype(np.int64))
            return len(rows) * len(cols)
        r, c = np.nonzero(alive)  # of the last level, whose rows and columns these are
        pairs = rows[(np.cumsum(on_rows) - 1)[r]], cols[(np.cumsum(on_cols) - 1)[c]]
    r, c = pairs
    other = q.ids[r] != x.ids[c]
    r, c = r[other], c[other]
    for a in range(0, len(r), 1 << 16):
        part = slice(a, a + (1 << 16))
        best.add(r[part], x.ids[c[part]], _exact(q.x[r[part]], x.x[c[part]]))
    return len(r)


def best_in_cell(q: Vectors, chunks: list[Vectors], k: int) -> Best:
    best = Best(len(q.ids), k)
    for chunk in chunks:
        look_through(q, chunk, best)
    return best


def _matrices(batches: Iterator[pa.RecordBatch], id_col: str, vector_col: str, scale: float, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(scale * component)) of up to ``rows`` vectors at a time; what takes no part is left out."""
    ids, parts, held = [], [], 0

    def stack() -> tuple[np.ndarray, np.ndarray]:
        width = max(1, *(p.shape[1] for p in parts))
        return np.concatenate(ids), np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])

    for batch in batches:
        lists = batch.column(vector_col)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        good = (wrong[ends] == wrong[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(id_col).is_valid().to_numpy(zero_copy_only=False)
        numbers = batch.column(id_col).fill_null(0).to_numpy()
        for width in np.unique(sizes[good]).tolist():
            mine = np.flatnonzero(good & (sizes == width))
            for a in range(0, len(mine), rows):
                some = mine[a : a + rows]
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * values[(ends - sizes)[some][:, None] + np.arange(width)[None, :]])
                ids.append(numbers[some])
                parts.append(np.clip(whole, -(2.0**63), 2.0**63))
                held += len(some)
                if held >= rows:
                    yield stack()
                    ids, parts, held = [], [], 0
    if held:
        yield stack()


def query_blocks(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows of up to 2 * QUERY_ROWS vectors: width, and ids and components as packed little-endian values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, id_col, vector_col, scale, QUERY_ROWS):
            narrow = bool(np.abs(x).max(initial=0) < 2**15)
            body = x.astype("<i2" if narrow else "<f8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([narrow]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([body], pa.binary())], ["width", "narrow", "ids", "body"])

    return map_arrow(vectors, run, _BLOCK)


def top_k(queries: DataFrame, candidates: DataFrame, id_col: str, vector_col: str, k: int, scale: float = 1.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query row, own id excluded."""
    read = [F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_vector")]
    first = Window.partitionBy("_id").orderBy("_vector")
    once = queries.select(*read).where("_id is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_id", "_vector")
    path = settle_at(query_blocks(once, "_id", "_vector", scale), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, "_id", "_vector", scale, CELL_ROWS):
            chunks = {x.shape[1]: Vectors(ids, x).chunks()}
            for block in open_table(path):
                for row in block.to_pylist():
                    width = max(row["width"], x.shape[1])
                    if width not in chunks:
                        chunks[width] = Vectors(ids, np.pad(x, ((0, 0), (0, width - x.shape[1])))).chunks()
                    of_q = np.frombuffer(row["ids"], "<i8")
                    body = np.frombuffer(row["body"], "<i2" if row["narrow"] else "<f8").reshape(len(of_q), row["width"]).astype(float)
                    q = Vectors(of_q, np.pad(body, ((0, 0), (0, width - row["width"]))))
                    best = best_in_cell(q, chunks[width], k)
                    yield pa.RecordBatch.from_arrays([pa.array(of_q[best.row]), pa.array(best.ids), pa.array(best.scores)], ["query_id", "vec_id", "score"])

    local = map_arrow(candidates.select(*read), run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
