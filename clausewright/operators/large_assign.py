"""One-to-one assignment where a group may be too large for a task: the same matches as ``assign``, in rounds over the cluster.

The candidates are written once.  Groups of up to ``STREAMED`` candidates stream through ``assign``; of larger ones

* greedy and gold-order matches are stable matchings: no free candidate is better than what both its sides have.  Deferred acceptance
  finds the only one: in a round every gold item proposes its best candidate that is left, every predicted item keeps the best proposal
  it gets, and all its candidates behind that one go.  A round is two aggregations and a join on the items, so a group is as many
  tasks as it has items; the rounds end when no proposal is turned down.
* the optimal assignment splits into the connected parts of the candidates, since a pair that is not there scores 0 and nothing scores
  less.  Parts are found by rounds of minimum labels, and each is solved by itself; one connected part still meets in one task.

Where candidates are products of vectors, ``gold_order_of_vectors`` makes them as it goes and writes none.  Where the score only falls with the square of the gap between two numbers, ``optimal_on_line`` needs no pairs at all.

Defined results: as ``assign``; scores must not be negative for ``optimal``; null keys are a group like others; repeated candidates
count once, with their best score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import assign, vectors

#: Candidates of a group that stream through one task.
STREAMED = 1_000_000
#: Pairs of vectors of a group whose scores one task makes and forgets, and how many it holds at once.
PRODUCTS, HELD = 4_000_000_000, 1 << 22


def _split(pairs: DataFrame, keys: list[str], least: float | None, streamed: int) -> tuple[Scratch, DataFrame, DataFrame | None]:
    """The candidates, written; those of small groups; those of large ones (null if there are none)."""
    rows = pairs if least is None else pairs.where(F.col("score") >= least)
    scratch = Scratch(pairs.sparkSession)
    typed = [F.col(c).cast("int").alias(c) for c in ("i", "j")]
    kept = scratch.write(rows.select(*keys, *typed, F.col("score").cast("double").alias("score")).groupBy(*keys, "i", "j").agg(F.max("score").alias("score")))
    large = scratch.write(kept.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > streamed).drop("_n"))
    if large.isEmpty():
        return scratch, kept, None
    on = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_p.{k}")) for k in keys]
    condition = on[0]
    for other in on[1:]:
        condition = condition & other
    few = kept.alias("_p").join(large.alias("_l"), condition, "left_anti")
    return scratch, few, scratch.write(kept.alias("_p").join(large.alias("_l"), condition, "left_semi"))


def _same(left: str, right: str, columns: list[str]) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return found


def _stable(scratch: Scratch, edges: DataFrame, keys: list[str], order: Callable[[], Column]) -> DataFrame:
    """The stable matching when both sides rank candidates by ``order`` (least first)."""
    edges = scratch.write(edges.withColumn("_o", order()))
    while True:
        proposals = edges.groupBy(*keys, "j").agg(F.min_by(F.struct("i", "score"), "_o").alias("e"), F.min("_o").alias("_o")).select(*keys, "e.i", "j", "e.score", "_o")
        proposals = scratch.write(proposals)
        best = scratch.write(proposals.groupBy(*keys, "i").agg(F.min_by(F.struct("j", "score"), "_o").alias("e"), F.min("_o").alias("_b")).select(*keys, "i", "e.j", "e.score", "_b"))
        if best.count() == proposals.count():
            return best.select(*keys, "i", "j", "score")
        left = edges.alias("e").join(best.select(*keys, "i", "_b").alias("b"), _same("e", "b", [*keys, "i"]), "left").where("b._b is null or e._o <= b._b").select("e.*")
        following = scratch.write(left)
        for done in (edges, proposals, best):
            scratch.drop(done)
        edges = following


def greedy(pairs: DataFrame, keys: list[str], threshold: float, streamed: int = STREAMED) -> DataFrame:
    """Best score first (ties: smaller i, then smaller j); a pair counts if neither side is taken."""
    scratch, few, many = _split(pairs, keys, threshold, streamed)
    found = assign.greedy(few, keys, threshold)
    return found if many is None else found.unionByName(_stable(scratch, many, keys, lambda: F.struct((-F.col("score")).alias("s"), "i", "j")))


def gold_order(pairs: DataFrame, keys: list[str], threshold: float, streamed: int = STREAMED) -> DataFrame:
    """Gold items in order; each takes its best unused candidate (first of ties) if that reaches the threshold."""
    scratch, few, many = _split(pairs, keys, threshold, streamed)
    found = assign.gold_order(few, keys, threshold)
    return found if many is None else found.unionByName(_stable(scratch, many, keys, lambda: F.struct("j", (-F.col("score")).alias("s"), "i")))


def _best_free(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and score of the matches in gold order of the inner products of the rows of ``x`` and ``y``, ids being distinct."""
    by_i, by_j = np.argsort(i), np.argsort(j)
    i, x, j, y = i[by_i], x[by_i], j[by_j], y[by_j]
    out, at = [], 0
    while at < len(j) and len(i):
        some = slice(at, at + max(1, HELD // len(i)))
        score = y[some] @ x.T
        score[~(score >= least)] = -np.inf
        free = np.ones(len(i), bool)
        for n, row in enumerate(score):
            best = int(row.argmax())  # the first of ties, so the smallest i
            if row[best] >= least:
                out.append((i[best], j[at + n], row[best]))
                free[best] = False
                score[n + 1 :, best] = -np.inf
        i, x, at = i[free], x[free], some.stop
    return tuple(map(np.array, zip(*out))) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def gold_order_of_vectors(found: DataFrame, gold: DataFrame, key: str, threshold: float, products: int = PRODUCTS) -> DataFrame:
    """``gold_order`` of ``vectors.product_pairs(found, gold, key, threshold)``.  A group of up to ``products`` pairs is its vectors in one task, which makes
    the scores of some gold items with what is still free and forgets them, so no candidate is written; a larger group, or one that
    repeats an id, lists its candidates and goes in rounds."""
    whole = lambda rows, c: rows.where(F.col(key).isNotNull() & F.col(c).isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    found, gold = (whole(rows, c).select(key, F.col(c).cast("int").alias(c), "v") for rows, c in ((found, "i"), (gold, "j")))
    size = lambda rows, c: rows.groupBy(key).agg(F.count("*").alias(f"_n{c}"), F.count_distinct(c).alias(f"_d{c}"))
    sizes = size(found, "i").join(size(gold, "j"), key)
    large = Scratch(found.sparkSession).write(sizes.where((F.col("_ni") > F.col("_di")) | (F.col("_nj") > F.col("_dj")) | (F.col("_ni") * F.col("_nj") > products)).select(key))

    def solved(left: pa.Table, right: pa.Table) -> pa.Table:
        matches = ((),) * 3
        if len(left) and len(right):
            (i, x), (j, y) = ((t.column(c).to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), -1)) for t, c in ((left, "i"), (right, "j")))
            matches = _best_free(i, x, j, y, threshold)
        group = [left.column("_key")[0].as_py()] * len(matches[0]) if len(left) else []
        return pa.table([pa.array(group, left.schema.field("_key").type), *[pa.array(c, kind) for c, kind in zip(matches, (pa.int32(), pa.int32(), pa.float64()))]], names=[key, "i", "j", "score"])

    # a new name, so that the two sides may come from one table
    grouped = lambda rows, c: rows.join(large, key, "left_anti").select(F.col(key).alias("_key"), F.size("v").alias("_length"), F.col(c).alias(c), F.col("v").alias("v")).groupBy("_key", "_length")
    kind = found.schema[key].dataType.simpleString()
    direct = grouped(found, "i").cogroup(grouped(gold, "j")).applyInArrow(solved, f"{key} {kind}, i int, j int, score double")
    if large.isEmpty():
        return direct
    listed = vectors.product_pairs(found.join(large, key, "left_semi"), gold.join(large, key, "left_semi"), key, threshold)
    return direct.unionByName(gold_order(listed, [key], threshold))


def connected_parts(scratch: Scratch, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` with column part: the least i of what is connected."""
    near = edges.groupBy(*keys, "j").agg(F.min("i").alias("part"))
    labels = scratch.write(near)
    while True:
        # an i takes the least label of its golds, a gold the least label of its i's
        mine = edges.alias("e").join(labels.alias("l"), _same("e", "l", [*keys, "j"])).select("e.*", "l.part").groupBy(*keys, "i").agg(F.min("part").alias("part"))
        of_i = scratch.write(mine)
        following = scratch.write(edges.alias("e").join(of_i.alias("l"), _same("e", "l", [*keys, "i"])).select("e.*", "l.part").groupBy(*keys, "j").agg(F.min("part").alias("part")))
        settled = following.alias("a").join(labels.alias("b"), _same("a", "b", [*keys, "j"])).where("a.part <> b.part").isEmpty()
        scratch.drop(labels)
        labels = following
        if settled:
            return edges.alias("e").join(of_i.alias("l"), _same("e", "l", [*keys, "i"])).select("e.*", "l.part")
        scratch.drop(of_i)


def optimal(pairs: DataFrame, keys: list[str], threshold: float, streamed: int = STREAMED) -> DataFrame:
    """The assignment of the greatest total score (a pair that is not there scores 0); pairs below the threshold are dropped afterwards, so
    one may use up a partner."""
    scratch, few, many = _split(pairs, keys, None, streamed)
    found = assign.optimal(few, keys, threshold)
    if many is None:
        return found
    parts = connected_parts(scratch, many.where("score > 0"), keys)
    return found.unionByName(assign.optimal(parts, [*keys, "part"], threshold).drop("part"))


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the sorted ``y`` meets each of the sorted ``x`` (no more than y) at the least sum of squared gaps.  That sum never
    falls when two partners cross, so a partner is the place in x and a shift that never falls; of each place the shifts at which the
    least sum so far falls are kept, as bits."""
    n, spare = len(x), len(y) - len(x)
    if not spare:
        return np.arange(n)
    least, falls = np.zeros(spare + 1, np.result_type(x, y)), []
    for at in range(n):
        least = least + (x[at] - y[at : at + spare + 1]) ** 2
        best = np.minimum.accumulate(least)
        falls.append(np.packbits(np.concatenate([[True], best[1:] < best[:-1]])))
        least = best
    shift, met = spare, np.empty(n, int)
    for at in range(n - 1, -1, -1):
        shift = int(np.flatnonzero(np.unpackbits(falls[at])[: shift + 1])[-1])
        met[at] = at + shift
    return met


def optimal_on_line(found: DataFrame, gold: DataFrame, keys: list[str], top: float, threshold: float) -> DataFrame:
    """``optimal`` where a pair scores ``top`` minus the square of the gap between its numbers: ``found`` has keys, i and x, ``gold`` keys, j and y (both whole
    or both doubles).  All items of the smaller side are matched, then pairs below the threshold are dropped.  A group is its sorted
    numbers in one task, and no pair is listed; sides of different counts take time and bits by the product of the smaller count and the
    difference.  Items without a key or number take no part."""
    sides = [rows.select(*keys, F.col(c).cast("int").alias(c), v).dropna() for rows, c, v in ((found, "i", "x"), (gold, "j", "y"))]
    fields = ", ".join(f"`{k}` {found.schema[k].dataType.simpleString()}" for k in keys)

    def solved(left: pa.Table, right: pa.Table) -> pa.Table:
        (i, x), (j, y) = ((t.column(c).to_numpy(), t.column(v).to_numpy()) for t, c, v in ((left, "i", "x"), (right, "j", "y")))
        by_x, by_y = np.lexsort((i, x)), np.lexsort((j, y))
        i, x, j, y = i[by_x], x[by_x], j[by_y], y[by_y]
        if len(x) <= len(y):
            met = _in_order(x, y)
            j, y = j[met], y[met]
        else:
            met = _in_order(y, x)
            i, x = i[met], x[met]
        score = top - ((x - y) ** 2).astype("float64")
        kept = np.flatnonzero(score >= threshold)
        group = [pa.array([left.column(k)[0].as_py()] * len(kept), left.schema.field(k).type) for k in keys] if len(left) else [pa.array([], right.schema.field(k).type) for k in keys]
        return pa.table([*group, pa.array(i[kept], pa.int32()), pa.array(j[kept], pa.int32()), pa.array(score[kept], pa.float64())], names=[*keys, "i", "j", "score"])

    return sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(solved, f"{fields}, i int, j int, score double")
