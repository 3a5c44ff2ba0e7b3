"""Toxicity by maximum-scoring segments.

Tokens are letter runs, lower-cased.  A token's score is its log-odds between toxic and other labelled texts, with
Dirichlet priors in two steps: the prior of a word is centred on what its six-byte prefix shows, the prefix's on
the whole corpus; one standard error is taken off, and a constant drift, so that a usual text scores downward.
A linear-time scan (all maximal scoring segments) finds every passage; a segment of score S in a text of n
tokens has the extreme-value excess x = lambda * S - ln(K n), where lambda solves sum p(s) exp(lambda s) = 1
over the tokens of texts that are not toxic, and K is the likeliest value for the best segments of those texts (the
law of the best score is exp(-K n exp(-lambda S))).  Passages with x > 0 are significant.  The best excess and the sum
of significant ones go through a logistic curve that is fitted on labelled texts; for K and for the curve, each half
of the texts is scored with the other half's counts.

At most ``sample`` labelled documents are used for fitting (those of the least hashed ids; a documented bound), and
they are written once for its passes.  Defined results: null and empty texts score like a text without a passage;
labels that are null don't train; of labels that disagree on a doc_id, toxic wins; rows of one doc_id train as one (its
least text); without both kinds of labelled text every score is the share of toxic ones.  Texts are read whole,
however long; each row, repeated ones too, gets its own result.  Columns of the input that are called like a result's
give way to it.  Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .sampling import least_hashed
from .storage import forget, map_arrow, settle_at

SAMPLE_ROWS, PREFIX_BYTES, DRIFT, LEAST_TEXTS = 20_000, 6, 0.5, 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word hashes, prefix hashes, range of words of each row, byte starts, byte ends)."""
    for low, high, data, offsets in ta.pieces(col):
        data = data.copy()
        upper = (data >= 65) & (data <= 90)
        data[upper] += 32
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[latin] += 32
        solid = _LETTER[data]
        first, last = solid.copy(), solid.copy()
        if len(data):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            first[inner] = solid[inner]
            last[inner - 1] = solid[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        words = ta.span_hashes(data, starts, ends)
        short = ta.span_hashes(data, starts, np.minimum(ends, starts + PREFIX_BYTES)) ^ np.uint64(1)
        yield low, words, short, np.searchsorted(starts, offsets), starts - np.repeat(offsets[:-1], np.diff(np.searchsorted(starts, offsets))), ends - np.repeat(offsets[:-1], np.diff(np.searchsorted(starts, offsets)))


@dataclass
class Lexicon:
    """Scores of words and prefixes by hash; everything else has the drift alone."""

    hashes: np.ndarray
    scores: np.ndarray
    lam: float
    k: float = 1.0

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, score) of the hashes that the lexicon has."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        k = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == hashes[at]
        return at[hit], self.scores[k[hit]]

    def positive(self, words: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores (drift included) of tokens that score upward; a word's own score goes before its prefix's."""
        score = np.full(len(words), -DRIFT)
        at, s = self.look_up(short)
        score[at] = s
        at, s = self.look_up(words)
        score[at] = s
        at = np.flatnonzero(score > 0)
        return at, score[at]


def maximal_segments(at: list[int], score: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) in one pass; between the given tokens every
    token scores -DRIFT.

    A segment on the stack keeps where the nearest one before it stands that begins lower: those between begin no
    lower than it does, so a search that meets it can go on from there, and all searches together take linear time."""
    # entries: first, last, cumulative score before, cumulative score after, place of the nearest entry that begins lower
    stack: list[tuple[int, int, float, float, int]] = []
    total, seen = 0.0, 0
    for i, s in zip(at, score):
        total -= DRIFT * (i - seen)
        seen = i + 1
        first, before, after = i, total, total + s
        total = after
        k = len(stack) - 1
        while True:
            while k >= 0 and stack[k][2] >= before:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= after:
                stack.append((first, i, before, after, k))
                break
            first, before, lower = stack[k][0], stack[k][2], stack[k][4]
            del stack[k:]
            k = lower
    return [(a, b, d - c) for a, b, c, d, _ in stack]


def passages_of(lexicon: Lexicon, col: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(row, tokens, maximal segments as byte spans with their score)."""
    for low, words, short, cuts, starts, ends in tokens(col):
        at, score = lexicon.positive(words, short)
        edges = np.searchsorted(at, cuts)
        for k in range(len(cuts) - 1):
            found = []
            if edges[k + 1] > edges[k]:
                first = int(cuts[k])
                found = [(int(starts[first + a]), int(ends[first + b]), s) for a, b, s in maximal_segments((at[edges[k] : edges[k + 1]] - first).tolist(), score[edges[k] : edges[k + 1]].tolist())]
            yield low + k, int(cuts[k + 1] - cuts[k]), found


def excesses(lexicon: Lexicon, col: pa.Array) -> Iterator[tuple[int, float, float, int, list[tuple[int, int, float]]]]:
    """(row, best excess, sum of significant ones, tokens, significant passages as byte spans)."""
    for row, n, found in passages_of(lexicon, col):
        usual = np.log(lexicon.k * n) if n else 0.0
        spans = [(a, b, float(lexicon.lam * s - usual)) for a, b, s in found]
        best = max((x for _, _, x in spans), default=-10.0)
        spans = [x for x in spans if x[2] > 0]
        yield row, max(-10.0, best), sum(x for _, _, x in spans), n, spans


def likeliest_k(n: np.ndarray, best: np.ndarray, lam: float) -> float:
    """K of greatest likelihood for the best scores of usual texts with n tokens."""
    return float(len(n) / max(1e-9, (n * np.exp(-np.clip(lam * best, 0, 700))).sum())) if len(n) else 1.0


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of 1, best excess, log(1 + sum)

    def score(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        z = self.weights[0] + self.weights[1] * np.clip(best, -10, 60) / 10 + self.weights[2] * np.log1p(total)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lexicon(y: np.ndarray, m: np.ndarray, hashes: np.ndarray, prefix: np.ndarray, is_word: np.ndarray, q: float, usual: np.ndarray, n_usual: float) -> Lexicon:
    """y, m: toxic and all texts that have each token; usual: occurrences in other texts."""
    kappa = 5.0
    share = (y + kappa * q) / (m + kappa)
    short = ~is_word
    order = np.argsort(hashes[short])
    known, theirs = hashes[short][order], share[short][order]
    centre = np.full(len(y), q)
    if len(known):
        k = np.minimum(np.searchsorted(known, prefix), len(known) - 1)
        centre = np.where(is_word & (known[k] == prefix), theirs[k], q)
    a, b = y + kappa * centre, m - y + kappa * (1 - centre)
    delta = np.log(a / b) - np.log(q / (1 - q)) - np.sqrt(1 / a + 1 / b) - DRIFT
    keep = (m >= LEAST_TEXTS) & (delta > -DRIFT)
    hashes, delta, usual = hashes[keep], delta[keep], usual[keep]
    rate = np.append((usual + 0.5) / (n_usual + 1), 1.0)
    step = np.append(delta, -DRIFT)
    rate[-1] = max(1e-9, 1 - rate[:-1].sum())
    low, high = 0.0, 4.0
    if (rate * step).sum() < 0 and (delta > 0).any():
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (rate * np.exp(np.clip(mid * step, -50, 50))).sum() < 1 else (low, mid)
    order = np.argsort(hashes)
    return Lexicon(hashes[order], delta[order], low if low > 0 else 1.0)


def fit(labelled: DataFrame) -> Model:
    """From the columns doc_id, text, toxic of a sample (see ``labelled_sample``)."""
    rows = labelled.where("toxic is not null").select("doc_id", "text", "toxic")
    path = settle_at(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"), (F.abs(F.xxhash64("doc_id", F.lit(7))) % 2).cast("int").alias("fold")), "labelled")
    try:
        return _fit(labelled.sparkSession.read.parquet(path))
    finally:
        forget(labelled.sparkSession, path)


def _fit(chosen: DataFrame) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, fold = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
            for low, words, short, cuts, _, _ in tokens(batch.column("text")):
                row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                both = np.concatenate([words, short])
                prefix = np.concatenate([short, short])
                kind = np.repeat([1, 0], len(words))
                rows_of = np.concatenate([row, row])
                order = np.lexsort((rows_of, both))
                both, prefix, kind, rows_of = both[order], prefix[order], kind[order], rows_of[order]
                new = np.concatenate([[True], (both[1:] != both[:-1]) | (rows_of[1:] != rows_of[:-1])]) if len(both) else np.zeros(0, bool)
                times = np.diff(np.concatenate([np.flatnonzero(new), [len(both)]]))
                both, prefix, kind, rows_of = both[new], prefix[new], kind[new], rows_of[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both.astype(np.int64)), pa.array(prefix.astype(np.int64)), pa.array(kind.astype(np.int32)), pa.array(toxic[low + rows_of]), pa.array(fold[low + rows_of]), pa.array(times.astype(np.int64))],
                    ["token", "prefix", "is_word", "toxic", "fold", "times"],
                )

    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), 1).otherwise(0)).alias(f"c{f}{t}") for f in (0, 1) for t in (0, 1)]
    use = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == 0), F.col("times")).otherwise(0)).alias(f"u{f}") for f in (0, 1)]
    seen = map_arrow(chosen, count, "token long, prefix long, is_word int, toxic int, fold int, times long")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in chosen.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n = {(f, t): sizes.get((f, t), 0) for f in (0, 1) for t in (0, 1)}
    toxic_all, other_all = n[0, 1] + n[1, 1], n[0, 0] + n[1, 0]
    if not toxic_all or not other_all:
        q = min(max((toxic_all + 0.5) / (toxic_all + other_all + 1), 1e-3), 1 - 1e-3)
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0), 1.0), np.array([np.log(q / (1 - q)), 0, 0]))
    per = seen.groupBy("token").agg(F.first("prefix").alias("prefix"), F.max("is_word").alias("is_word"), *sums, *use)
    # tokens of enough texts, with a lead among the toxic ones: bounded by the sample
    lead = (F.col("c01") + F.col("c11")) * other_all > (F.col("c00") + F.col("c10")) * toxic_all
    got = per.where((F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11") >= LEAST_TEXTS) & lead).toPandas()
    totals = seen.where("is_word = 1 and toxic = 0").groupBy("fold").agg(F.sum("times").alias("n")).collect()
    usual = {r["fold"]: float(r["n"]) for r in totals}
    col = {c: got[c].to_numpy() for c in got.columns}
    hashes, prefix, is_word = col["token"].astype(np.int64).view(np.uint64), col["prefix"].astype(np.int64).view(np.uint64), col["is_word"] == 1

    def of(folds: tuple[int, ...]) -> Lexicon:
        y = sum(col[f"c{f}1"] for f in folds).astype(float)
        m = y + sum(col[f"c{f}0"] for f in folds).astype(float)
        toxic, other = sum(n[f, 1] for f in folds), sum(n[f, 0] for f in folds)
        q = min(max((toxic + 0.5) / (toxic + other + 1), 1e-3), 1 - 1e-3)
        return _lexicon(y, m, hashes, prefix, is_word, q, sum(col[f"u{f}"] for f in folds).astype(float), sum(usual.get(f, 0) for f in folds))

    crossed = {0: of((1,)), 1: of((0,))}

    def crossed_rows(make, schema: str):
        """What ``make`` says of each text, by the lexicon of the other half; at most one row a text of the sample."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                toxic, fold = batch.column("toxic").to_numpy(), batch.column("fold").to_numpy()
                for f in (0, 1):
                    mine = np.flatnonzero(fold == f)
                    out = [(int(toxic[mine[i]]), f, x, y) for i, x, y in make(crossed[f], batch.column("text").take(pa.array(mine)))]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["toxic", "fold", "x", "y"])

        return map_arrow(chosen, run, schema).toPandas()

    schema = "toxic int, fold int, x double, y double"
    usual_rows = crossed_rows(lambda lexicon, col: ((i, float(n), max((s for _, _, s in found), default=0.0)) for i, n, found in passages_of(lexicon, col)), schema)
    usual_rows = usual_rows[(usual_rows["toxic"] == 0) & (usual_rows["x"] > 0)]
    for f in (0, 1):
        mine = usual_rows[usual_rows["fold"] == f]
        crossed[f].k = likeliest_k(mine["x"].to_numpy(), mine["y"].to_numpy(), crossed[f].lam)
    rows = crossed_rows(lambda lexicon, col: ((i, best, total) for i, best, total, _, _ in excesses(lexicon, col)), schema)
    x = np.stack([np.ones(len(rows)), np.clip(rows["x"], -10, 60) / 10, np.log1p(rows["y"])], 1)
    y, w = rows["toxic"].to_numpy(float), np.zeros(3)
    ridge = np.diag([1e-3, 0.1, 0.1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
    w[1:] = np.maximum(w[1:], 0)
    whole = of((0, 1))
    whole.k = float(np.sqrt(crossed[0].k * crossed[1].k))
    return Model(whole, w)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most ``sample`` labelled documents (the least hashed doc_ids)."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = least_hashed(known, sample)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` pairs of numbers
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def score(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """``docs`` with toxicity (0..1) and, on demand, passages: significant byte spans with their excess."""
    docs = docs.drop("toxicity", "passages")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in docs.schema]
    extra = [T.StructField("toxicity", T.DoubleType())]
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("excess", pa.float64())]))
    if passages:
        extra.append(T.StructField("passages", T.ArrayType(T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()), T.StructField("excess", T.DoubleType())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            rows = list(excesses(m.lexicon, batch.column("text")))
            s = m.score(np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) if rows else np.zeros(0)
            cols = [*[batch.column(c) for c in names], pa.array(s)]
            if passages:
                cols.append(pa.array([[{"low": a, "high": b, "excess": x} for a, b, x in r[4]] for r in rows], kind))
            yield pa.RecordBatch.from_arrays(cols, [*names, *[f.name for f in extra]])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, *extra]))


def drop_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            rows = list(excesses(m.lexicon, batch.column("text")))
            if rows:
                yield batch.filter(pa.array(m.score(np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) < threshold))

    return map_arrow(docs, run, docs.schema)
