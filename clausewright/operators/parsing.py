"""Parsers of model responses: tagged blocks, delimited blocks, pipe lines, lists, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewriting import let
from ..functions.rules import trim_all

# Fixed value: the mark of an exception that another task explains.
CROSS_REFERENCE = "[CROSS_REF]"


def tagged(response: Column, tag: str, fallback: Column | None = None) -> Column:
    """What stands inside <tag>...</tag>, else the fallback (the response itself, if none)."""
    inside = trim_all(F.regexp_extract(response, f"(?is)<{tag}>(.*?)</{tag}>", 1))
    return F.coalesce(F.nullif(inside, F.lit("")), response if fallback is None else fallback)


def unfenced(response: Column) -> Column:
    """The content of a code fence, else the whole."""
    return trim_all(F.coalesce(F.nullif(F.regexp_extract(response, r"(?is)```(?:xml|json)?\s*(.*?)```", 1), F.lit("")), response))


def json_rows(response: Column, schema: str) -> Column:
    """A fenced or bare JSON value; null where it is malformed."""
    return F.from_json(unfenced(response), schema, {"mode": "PERMISSIVE"})


def listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";;"), trim_all), lambda x: x != "")


def exceptions(text: Column) -> Column:
    """array<struct<description, needs_cross_ref>> of a ``;;`` list; the mark [CROSS_REF] sets the flag and goes."""
    marked = F.transform(listed(text), lambda x: F.struct(trim_all(F.replace(x, F.lit(CROSS_REFERENCE), F.lit(""))).alias("description"), F.contains(x, F.lit(CROSS_REFERENCE)).alias("needs_cross_ref")))
    return F.filter(marked, lambda x: x["description"] != "")


def performers(text: Column) -> Column:
    """array<struct<unit, role, text>> of a ``;;`` list: unit and role of ``unit: X, role: Y`` or ``X/Y``; anything else has
    only its text, for a look-up.  ``(none)`` and half of a slash say nothing; of equal ones the first stays, in the order of the text."""

    def entry(x: Column) -> Column:
        unit, role = F.regexp_extract(x, r"(?i)unit\s*:\s*([^,]+)", 1), F.regexp_extract(x, r"(?i)role\s*:\s*([^,;]+)", 1)
        named = (unit != "") & (role != "")
        slash = F.instr(x, "/")
        pair = lambda u, r: F.struct(trim_all(u).alias("unit"), trim_all(r).alias("role"), x.alias("text"))
        none = F.lit(None).cast("string")
        split = pair(F.substring(x, F.lit(1), slash - 1), F.substr(x, slash + 1))
        return F.when(named, pair(unit, role)).when(slash > 0, split).otherwise(F.struct(none.alias("unit"), none.alias("role"), x.alias("text")))

    every = F.transform(F.filter(listed(text), lambda x: x != "(none)"), entry)
    said = F.filter(every, lambda e: e["unit"].isNull() | ((e["unit"] != "") & (e["role"] != "")))
    same = lambda a, b: F.when(a["unit"].isNull(), b["unit"].isNull() & (a["text"] == b["text"])).otherwise(F.coalesce((a["unit"] == b["unit"]) & (a["role"] == b["role"]), F.lit(False)))
    return let(said, lambda s: F.filter(s, lambda e, i: ~F.exists(F.slice(s, F.lit(1), i), lambda b: same(e, b))))


def task_blocks(responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_no, label, performers, deontic_type, deontic_modality, conditions, exceptions, source_article,
    source_paragraph: one row a ``---TASK---`` ... ``---END---`` block with its ``key: value`` lines (the last of a key
    wins); blocks without a label are dropped, a missing key takes its default, a key without a value is empty."""
    rows = responses.select(key, F.posexplode(F.regexp_extract_all("response", F.lit(r"(?s)---TASK---(.*?)---END---"), F.lit(1))).alias("block_no", "block"))

    def field(name: str, default: str = "") -> Column:
        values = F.regexp_extract_all("block", F.lit(rf"(?im)^[ \t]*{name}[ \t]*:(.*)$"), F.lit(1))
        return trim_all(F.coalesce(F.get(values, F.size(values) - 1), F.lit(default)))

    return rows.select(
        key,
        "block_no",
        field("label").alias("label"),
        performers(field("performers")).alias("performers"),
        field("deontic_type", "obligation").alias("deontic_type"),
        field("deontic_modality", "shall").alias("deontic_modality"),
        listed(field("conditions")).alias("conditions"),
        exceptions(field("exceptions")).alias("exceptions"),
        field("article", "UNKNOWN").alias("source_article"),
        field("paragraph", "UNKNOWN").alias("source_paragraph"),
    ).where("label <> ''")


def actor_lines(responses: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, name, actor_type of ``name | TYPE`` lines with TYPE in UNIT, ROLE, BOTH; the first of a name (without
    case) and type."""
    rows = responses.select(key, F.posexplode(F.split("response", "\n")).alias("line_no", "line"))
    parts = rows.select(key, "line_no", F.transform(F.split("line", r"\|"), trim_all).alias("p")).where(F.size("p") == 2)
    good = parts.select(key, "line_no", F.col("p")[0].alias("name"), F.upper(F.col("p")[1]).alias("actor_type")).where("name <> '' and actor_type in ('UNIT', 'ROLE', 'BOTH')")
    first = Window.partitionBy(key, F.lower("name"), "actor_type").orderBy("line_no")
    return good.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def relation_lines(responses: DataFrame, key: str = "doc_id", reset: bool = True) -> DataFrame:
    """key, line_no, child, parent, relation of ``CHILD | PARENT | TYPE`` lines of exactly three parts, TYPE being UNIT, ROLE
    or ROLE-UNIT (also with a space); with ``reset``, a line with NO_HIERARCHIES, in any case, drops whatever its answer
    says."""
    rows = responses.select(key, "response", F.posexplode(F.split("response", "\n")).alias("line_no", "line"))
    if reset:
        rows = rows.where(~F.contains(F.upper("response"), F.lit("NO_HIERARCHIES")))
    parts = rows.select(key, "line_no", F.transform(F.split("line", r"\|"), trim_all).alias("p")).where("size(p) = 3 and p[0] <> '' and p[1] <> ''")
    found = parts.select(key, "line_no", F.col("p")[0].alias("child"), F.col("p")[1].alias("parent"), F.replace(F.upper(F.col("p")[2]), F.lit(" "), F.lit("-")).alias("relation"))
    return found.where(F.col("relation").isin("UNIT", "ROLE", "ROLE-UNIT"))


def rule_share(answers: Column) -> Column:
    """Right over all of an array of booleans; null for an empty or missing one."""
    right = F.size(F.filter(answers, lambda x: F.coalesce(x, F.lit(False))))
    return F.when(F.size(answers) > 0, right / F.nullif(F.size(answers), F.lit(0)))
