"""Calls of a language model: prompts as columns, providers, and the stages that use them.

A provider answers a table of requests.  ``Replay`` looks answers up by prompt; ``Calls`` asks a client, one a
partition, from ``mapInPandas``.  Parsers of answers are in ``parsing`` and are plain expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsing import tagged


@dataclass(frozen=True)
class Stage:
    """A kind of call: its output limit, temperature, and the tag that a validator's answer is inside."""

    name: str
    max_tokens: int
    temperature: float = 0.1
    tag: str | None = None


# The stages and their settings.
STAGES = {
    s.name: s
    for s in [
        Stage("actors", 4096),
        Stage("actors_validated", 4096, 0.3, "FINAL_LIST"),
        Stage("hierarchy", 4092),
        Stage("hierarchy_validated", 4092, 0.3, "FINAL_HIERARCHIES"),
        Stage("tasks", 16384),
        Stage("tasks_validated", 16384, 0.3, "FINAL_TASKS"),
        Stage("description", 8192),
        Stage("description_validated", 8192, 0.3, "FINAL_DESCRIPTION"),
        Stage("testset", 8192, 0.2),
        Stage("testset_validated", 8192, 0.0, "FINAL_DESCRIPTION"),
    ]
}


class Provider(Protocol):
    def complete(self, requests: DataFrame, stage: Stage) -> DataFrame:
        """requests (with a column ``prompt``) with a column ``response``; null where there is no answer."""


def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


@dataclass
class Replay:
    """Answers from a table (stage, prompt_hash, response); the smallest of several."""

    answers: DataFrame

    def complete(self, requests: DataFrame, stage: Stage) -> DataFrame:
        known = self.answers.where(F.col("stage") == stage.name).groupBy("prompt_hash").agg(F.min("response").alias("response"))
        return requests.withColumn("prompt_hash", prompt_hash(F.col("prompt"))).join(known, "prompt_hash", "left").drop("prompt_hash")


@dataclass
class Calls:
    """Answers of a client that ``connect`` makes on the executor: client(prompt, max_tokens, temperature) -> text parts
    or text.  Parts are joined and trimmed."""

    connect: Callable[[], Callable[[str, int, float], str | list[str]]]

    def complete(self, requests: DataFrame, stage: Stage) -> DataFrame:
        connect, limit, heat = self.connect, stage.max_tokens, stage.temperature

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = connect()
            for batch in batches:
                answers = [None if p is None else client(p, limit, heat) for p in batch["prompt"]]
                yield batch.assign(response=[a if a is None or isinstance(a, str) else "".join(x for x in a if x) for a in answers]).assign(response=lambda d: d["response"].str.strip())

        return requests.mapInPandas(ask, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema)}, response string")


def ask(rows: DataFrame, provider: Provider, stage: str, prompt: Column, out: str) -> DataFrame:
    """``rows`` with the answer of one stage as ``out``."""
    return provider.complete(rows.withColumn("prompt", prompt), STAGES[stage]).withColumnRenamed("response", out).drop("prompt")


def validated(rows: DataFrame, provider: Provider, stage: str, prompt: Column, previous: str, out: str, keep_previous: bool = False) -> DataFrame:
    """A validator pass over ``previous``: what stands in the stage's tag, else the whole answer (or, with
    ``keep_previous``, what was there before); without an answer what was there before."""
    asked = ask(rows, provider, stage, prompt, "_answer")
    fallback = F.col(previous) if keep_previous else F.col("_answer")
    return asked.withColumn(out, F.coalesce(tagged(F.col("_answer"), STAGES[stage].tag, fallback), F.col(previous))).drop("_answer")


def hybrid(rows: DataFrame, n_candidates: Column, with_candidates: Column, plain: Column, least: int = 2) -> DataFrame:
    """Adds ``prompt`` and ``fell_back``: the prompt with candidates, or the plain one where they are too few."""
    few = n_candidates < least
    return rows.withColumn("fell_back", few).withColumn("prompt", F.when(few, plain).otherwise(with_candidates))


def sectioned(instruction: str, *parts: tuple[str, Column], ending: str = "") -> Column:
    """A prompt: the instruction, then each part under its title, then the ending."""
    pieces = [F.lit(instruction)]
    for title, body in parts:
        pieces += [F.lit(f"\n\n{title}:\n"), F.trim(body)]
    return F.concat(*pieces, F.lit(ending))


def _joined(lines: Column, sep: str) -> Column:
    return F.coalesce(F.array_join(lines, sep), F.lit(""))


def candidate_block(label: str = "label") -> Column:
    """A task candidate as a delimited block."""
    conditions = F.coalesce(F.nullif(_joined(F.col("conditions"), " ;; "), F.lit("")), F.lit("(none)"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    return F.concat_ws("\n", F.lit("---CANDIDATE---"), field("label", F.col(label)), field("deontic_type", F.col("deontic_type")), field("deontic_modality", F.col("deontic_modality")), field("conditions", conditions), field("article", F.col("source_article")), field("paragraph", F.col("source_paragraph")), F.lit("---END---"))


def task_block() -> Column:
    """A task as a delimited block that ``parsing.task_blocks`` reads."""
    people = _joined(F.transform("performers", lambda p: F.concat(p["unit"], F.lit("/"), p["role"])), " ;; ")
    exceptions = _joined(F.transform("exceptions", lambda e: F.concat(e["description"], F.when(e["needs_cross_ref"], "[CROSS_REF]").otherwise(""))), " ;; ")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    values = {"label": F.col("label"), "performers": people, "deontic_type": F.col("deontic_type"), "deontic_modality": F.col("deontic_modality"), "conditions": _joined(F.col("conditions"), " ;; "), "exceptions": exceptions, "article": F.col("source_article"), "paragraph": F.col("source_paragraph")}
    return F.concat_ws("\n", F.lit("---TASK---"), *[field(n, v) for n, v in values.items()], F.lit("---END---"))


def task_sentence() -> Column:
    """A task as the description stage reads it: actors, modal, label, then its conditions, exceptions and source."""
    actors = F.when(F.size("actors") > 0, F.array_join("actors", " or ")).otherwise("Unknown Actor")
    lines = lambda column, title: F.transform(column, lambda x: F.concat(F.lit(f"  {title}: "), x))
    head = F.concat(F.lit("["), F.col("task_id"), F.lit("] "), actors, F.lit(" "), F.col("deontic_modality"), F.lit(" "), F.col("label"))
    source = F.concat(F.lit("  SOURCE: Article "), F.col("source_article"), F.lit(", §"), F.col("source_paragraph"))
    return F.array_join(F.concat(F.array(head), lines("conditions", "CONDITION"), lines("exceptions", "EXCEPTION"), F.array(source)), "\n")


def task_order() -> list[Column]:
    """Article number (else 999), paragraph number and letter (unknown last), number of the task id (else 0)."""
    number = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(999))
    paragraph = F.col("source_paragraph")
    letter = F.when(paragraph == "UNKNOWN", "").when(paragraph.rlike(r"^\d"), F.regexp_extract(paragraph, r"^\d+(?:\(([a-z])\))?", 1)).otherwise(paragraph)
    task = F.coalesce(F.nullif(F.regexp_extract("task_id", r"^.(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return [number(F.col("source_article")), number(paragraph), letter, task]


def subject_line() -> Column:
    return F.concat(F.lit("unit: "), F.col("unit"), F.lit(", role: "), F.col("role"))


def mapping_line() -> Column:
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    return F.concat(F.lit("- label="), quoted("label"), F.lit(" | role="), quoted("role"), F.lit(" | unit="), quoted("unit"))


def put_together(rows: DataFrame, keys: list[str], order: list[Column], line: Column, sep: str, out: str) -> DataFrame:
    """keys, out: the lines of each key in order."""
    packed = F.struct(*[c.alias(f"_{n}") for n, c in enumerate(order)], line.alias("_line"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["_line"]), sep).alias(out))
