"""Scores of predicted process descriptions against gold ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics, rules
from ..functions.similarity import name_score
from ..operators import assign, segment
from .evaluation import ENTITY_THRESHOLD

#: A token is a run of word characters with inner hyphens or apostrophes, or one other mark.
TOKEN = r"(?U)\w+(?:['’-]\w+)*|[^\w\s]"


def token_statistics(text: Column, cut: Column, prefix: str = "") -> list[Column]:
    """Tokens, sentences, the mean of the sentences' lengths, and tokens over sentences.  ``cut`` has the sentences of ``text``; no token holds the
    space between two, so their lengths add up to the text's."""
    tokens = F.regexp_count(text, F.lit(TOKEN))
    ratio = F.when(F.size(cut) == 0, 0.0).otherwise(F.round(tokens / F.nullif(F.size(cut), F.lit(0)), 4))
    return [tokens.alias(f"{prefix}total_tokens"), F.size(cut).alias(f"{prefix}total_sentences"), ratio.alias(f"{prefix}avg_tokens_per_sentence"), ratio.alias(f"{prefix}tokens_per_sentence")]


_TASK = "array<struct<actor:string,deontic:string,activity:string,key:string>>"


def _low(name: Column) -> Column:
    return F.lower(F.trim(name))


def _said(texts: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """What one side's descriptions say, a row each: statistics, stated actors, and tasks in order with what tells equal ones."""
    text = F.col("text")
    # one column a step, so that a text is cut once
    rows = texts.select(*keys, "text", segment.sentences(text).alias("_cut"))
    task = lambda x: F.struct(_low(x["actor"]).alias("actor"), x["deontic"].alias("deontic"), _low(x["activity"]).alias("activity"), F.to_json(F.array(F.lower(x["actor"]), x["deontic"], F.lower(F.substring(x["activity"], 1, 60)))).alias("key"))
    xor, both = rules.word_count(rules.XOR_WORDS, text), rules.word_count(rules.AND_WORDS, text)
    actors = F.transform(segment.listed_actors(F.col("_cut")), _low)
    found = segment.clause_tasks(segment.cut_further(F.col("_cut")))
    return rows.select(*keys, *token_statistics(text, F.col("_cut"), prefix), xor.alias(f"{prefix}xor"), both.alias(f"{prefix}and"), actors.alias(f"{prefix}actors"), F.transform(found, task).cast(_TASK).alias(f"{prefix}tasks"))


def _scored_assignment(threshold: float):
    """Of two lists of lower-case names: (i, j, score) of the best total whose score reaches the threshold."""

    @lru_cache(1 << 16)
    def score(a: str, b: str) -> float:
        return name_score(a, b)

    @lru_cache(1 << 10)
    def best(scores: tuple[tuple[float, ...], ...]) -> list[tuple[int, int]]:
        return assign.hungarian(np.array(scores))

    def run(found: list[str], gold: list[str]) -> list[tuple[int, int, float]]:
        if not found or not gold:
            return []
        if len(found) * len(gold) <= 64:
            scores = tuple(tuple(score(f, g) for g in gold) for f in found)
            met = best(scores)
        else:
            scores = np.array([[score(f, g) for g in gold] for f in found])
            met = assign.hungarian(scores)
        return [(i, j, float(scores[i][j])) for i, j in met if scores[i][j] >= threshold]

    return run, score


def _lists(column: pa.Array, fields: list[str] | None = None):
    """An array column's rows: a list of values, or of the values of each field."""
    if fields is None:
        yield from ([] if row is None else row for row in column.to_pylist())
        return
    flat = column.flatten()
    values = [flat.field(f).to_pylist() for f in fields]
    at = 0
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield [v[at : at + n] for v in values]
        at += n


def _meet(threshold: float):
    """Rows with both sides' actors and tasks: adds the counts of each, of their matches, and of equal modals and alike actors of matched tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigned, score = _scored_assignment(threshold)

        def first(tasks: list[list]) -> list[list]:
            seen: dict[str, int] = {}
            for n, key in enumerate(tasks[3]):
                seen.setdefault(key, n)
            return tasks if len(seen) == len(tasks[3]) else [[v[n] for n in seen.values()] for v in tasks]

        for batch in batches:
            fields, out = ["actor", "deontic", "activity", "key"], []
            sides = [_lists(batch.column(c), f) for c, f in (("pred_tasks", fields), ("gold_tasks", fields), ("pred_actors", None), ("gold_actors", None))]
            for f, g, f_actors, g_actors in zip(*sides):
                f, g = first(f), first(g)
                met = assigned(f[2], g[2])
                named = assigned(f_actors, g_actors)
                out.append((len(g[0]), len(f[0]), len(met), sum(x[2] for x in met), sum(f[1][i] == g[1][j] for i, j, _ in met), sum(score(f[0][i], g[0][j]) >= threshold for i, j, _ in met), len(g_actors), len(f_actors), len(named)))
            kept = [n for n in batch.schema.names if not n.endswith(("_tasks", "_actors"))]
            columns = [batch.column(n) for n in kept] + [pa.array(c, pa.float64() if name == "_s" else pa.int64()) for name, c in zip(_COUNTS, zip(*out) if out else [[]] * len(_COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *_COUNTS])

    return run


_COUNTS = ["gold_task_count", "pred_task_count", "matched_tasks", "_s", "_d", "matched_task_actors", "gold_actor_count", "pred_actor_count", "_a"]


def evaluate(found: DataFrame, gold: DataFrame, keys: list[str], threshold: float = ENTITY_THRESHOLD) -> DataFrame:
    """One row a pair of descriptions (keys, text on both sides): token statistics, actors, gateways, tasks by activity (optimal
    assignment), modals.  Each text is read once; the two sides meet in one join, and a pair's lists are matched in its row."""
    rows = _said(gold, keys, "gold_").join(_said(found, keys, "pred_").hint("merge"), keys)
    kept = [f for f in rows.schema if not f.name.endswith(("_tasks", "_actors"))]
    counts = [T.StructField(c, T.DoubleType() if c == "_s" else T.LongType()) for c in _COUNTS]
    rows = rows.mapInArrow(_meet(threshold), T.StructType([*kept, *counts]))
    tp, d, n_f, n_g = (F.col(c) for c in ("matched_tasks", "_d", "pred_task_count", "gold_task_count"))
    mean = F.when(tp == 0, 0.0).otherwise(F.round(F.col("_s") / F.nullif(tp, F.lit(0)), 4))
    scores = [s.alias(f"task_{x}") for s, x in zip(metrics.prf(tp, n_f - tp, n_g - tp), ("precision", "recall", "f1"))]
    scores += [s.alias(f"deontic_{x}") for s, x in zip(metrics.prf(d, n_f - d, n_g - d), ("precision", "recall", "f1"))]
    a, f, g = F.col("_a"), F.col("pred_actor_count"), F.col("gold_actor_count")
    named = [s.alias(f"actor_{x}") for s, x in zip(metrics.prf(a, f - a, g - a), ("precision", "recall", "f1"))]
    ratios = [metrics.count_ratio(F.col(f"gold_{kind}"), F.col(f"pred_{kind}")).alias(f"{kind}_ratio") for kind in ("xor", "and")]
    return rows.select(*[x.name for x in kept], "gold_task_count", "pred_task_count", "matched_tasks", "matched_task_actors", mean.alias("avg_task_similarity"), *scores, "gold_actor_count", "pred_actor_count", *named, *ratios)
