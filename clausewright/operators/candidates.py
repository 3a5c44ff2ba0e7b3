"""Candidates that rules find in texts: actors by four layers, tasks by their modals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.rules import trim_all
from ..sources.scratch import Scratch
from .entities import drop_plurals
from . import grammar
from .segment import sentences, sums_before
from .words import ACTION_VERBS, CONDITION_MARKERS, DELEGATING_VERBS, INSTITUTIONS, NOT_ACTORS, REQUESTING_VERBS

# Fixed values.
SKIPPED_LINE = r"(?s)^--.*--|^\s*$"
PARAGRAPH_MARK = r"^[ \t]*(\d{1,2}(?:\([a-z]\))?)\s*(?:[.\s]|$)"
MINIMUM_CANDIDATES = 2

_MODALS = r"(?i)\b((?:shall|must|may|should)(?:\s+not)?|(?:is|are)\s+required\s+to)\s+"


def is_actor(name: Column) -> Column:
    """Not a thing by its first letters (``Data Protection Board`` counts as one)."""
    return ~name.rlike(rf"(?i)^(?:{'|'.join(NOT_ACTORS)})")


def specific(name: Column) -> Column:
    """Several words, or one that begins with a capital."""
    return (F.size(F.split(trim_all(name), r"\s+")) > 1) | name.rlike(r"^\p{Lu}")


def institutions(docs: DataFrame) -> DataFrame:
    """doc_id, name, actor_type: known bodies as the text writes them, those inside the name of another too."""
    phrases = [r"\b" + re.escape(name) + r"\b" for name in INSTITUTIONS]
    # small letters are made once a text; an outer explode, since a plain one has its array's size tested below it, which would search twice
    docs = docs.select("doc_id", "text", F.lower("text").alias("_low"))
    found = [F.when(F.contains(F.col("_low"), F.lit(name.lower())), F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(0))) for name, p in zip(INSTITUTIONS, phrases)]
    names = F.flatten(F.array(*[F.coalesce(f, F.array().cast("array<string>")) for f in found]))
    return docs.select("doc_id", F.explode_outer(F.array_distinct(names)).alias("name"), F.lit("UNIT").alias("actor_type")).where("name is not null").distinct()


def noun_groups(docs: DataFrame) -> DataFrame:
    """doc_id, at, name, verb: the noun groups of every sentence of every line, by their arcs, without determiners; ``verb`` is the verb whose
    subject a group is (null for others); pronouns are none."""
    lines = docs.select("doc_id", F.explode_outer(F.split("text", "\n")).alias("_line")).select("doc_id", F.explode_outer(sentences(F.col("_line"))).alias("_s")).where("_s <> ''")
    # parsing costs far more than moving a sentence, so sentences are dealt out first, however few parts the texts come in
    lines = lines.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = grammar.noun_groups(lines, "_s", "_g").select("doc_id", F.posexplode_outer("_g").alias("at", "_x")).where("_x is not null")
    return rows.select("doc_id", "at", "_x.name", "_x.verb").where("name <> ''")


def named(groups: DataFrame) -> DataFrame:
    """doc_id, name, n_total, n_subject, subjects: noun groups that are equal without case, as last written with a capital (else as first
    written), and the (name, actor_type) of those that are subjects: roles where the verb begins like an action verb, others by
    their suffix."""
    capital = F.when(F.col("name").rlike(r"^\p{Lu}"), F.struct("at", "name"))
    shown = F.coalesce(F.max_by("name", capital), F.min_by("name", F.struct("at", "name"))).alias("name")
    kind = F.when(F.col("verb").rlike(rf"(?i)^(?:{'|'.join(ACTION_VERBS)})"), "ROLE").otherwise(rules.infer_type(F.col("name")))
    subject = F.when(F.col("verb").isNotNull(), F.struct("name", kind.alias("actor_type")))
    return groups.groupBy("doc_id", F.lower("name").alias("_low")).agg(shown, F.count("*").alias("n_total"), F.count("verb").alias("n_subject"), F.collect_set(subject).alias("subjects")).drop("_low")


def _frequent(least: int) -> Column:
    return (F.col("n_total") >= least) & (F.col("n_subject") > 0) & (F.size(F.split("name", r"\s+")) <= 6)


def frequent_names(docs: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, name, n_total, n_subject: names of at most six words that occur ``least`` times, at least once as a subject."""
    return named(noun_groups(docs)).where(_frequent(least)).drop("subjects")


def actor_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, name, actor_type of all layers, distinct, without things, vague words and plurals of other names.  What the layers find is
    written once, so that the texts are parsed once."""
    often = F.when(_frequent(2), F.array(F.struct("name", rules.infer_type(F.col("name")).alias("actor_type"))))
    none = F.array().cast("array<struct<name:string,actor_type:string>>")
    found = named(noun_groups(docs)).select("doc_id", F.explode(F.concat("subjects", F.coalesce(often, none))).alias("_x")).select("doc_id", "_x.*").where(is_actor(F.col("name")))
    every = institutions(docs).unionByName(found).where(specific(F.col("name"))).distinct()
    return drop_plurals(Scratch(docs.sparkSession).write(every), ["doc_id", "actor_type"])


def candidate_order() -> list[Column]:
    """Units before roles, each by name."""
    return [F.col("actor_type").desc(), F.col("name")]


def source_article(text: Column) -> Column:
    """The first ``Article n`` of the whole text, else UNKNOWN."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)\bArticle\s+(\d+[a-z]?)", 1), F.lit("")), F.lit("UNKNOWN"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, source_article, at, line, source_paragraph: lines with the offset of their first character and the last paragraph mark up to them,
    found in the document's row."""
    # documents are dealt out first, however few parts they come in
    docs = docs.select("doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    split = docs.select("doc_id", source_article(F.col("text")).alias("source_article"), F.split(F.coalesce("text", F.lit("")), "\n").alias("line"))
    marks = F.transform("line", lambda s: F.nullif(F.regexp_extract(s, PARAGRAPH_MARK, 1), F.lit("")))
    rows = split.withColumn("mark", marks).withColumn("at", sums_before(F.transform("line", lambda s: F.length(s) + 1)))
    rows = rows.withColumn("marked", sums_before(F.transform("mark", lambda m: m.isNotNull().cast("int")))).withColumn("_marks", F.filter("mark", lambda m: m.isNotNull()))
    # an outer explode, since a plain one has its array's size tested below it, which would work it out twice
    rows = rows.select("doc_id", "source_article", "_marks", F.explode_outer(F.arrays_zip("line", "mark", "at", "marked")).alias("_x")).where("_x is not null")
    last = F.coalesce("_x.mark", F.get("_marks", F.col("_x.marked") - 1), F.lit("UNKNOWN"))
    return rows.select("doc_id", "source_article", "_x.at", "_x.line", last.alias("source_paragraph"))


def task_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, at, n, label, deontic_type, deontic_modality, conditions, source_article, source_paragraph, sentence: a row a
    modal and verb; verbs joined by ``and`` are split; what a delegating or requesting verb hands on is a row of its
    own.  Marker lines and blank lines are skipped.  Documents are shuffled once; only ``n`` needs a window."""
    lines = _lines(docs).where(~F.col("line").rlike(SKIPPED_LINE))
    rows = lines.select("doc_id", "at", "source_article", "source_paragraph", F.posexplode_outer(sentences(F.col("line"))).alias("_s", "sentence")).where("sentence is not null")
    modal = F.regexp_extract_all("sentence", F.lit(_MODALS + r"([^;.]*)"), F.lit(1))
    phrase = F.regexp_extract_all("sentence", F.lit(_MODALS + r"([^;.]*)"), F.lit(2))
    rows = rows.withColumn("_m", F.explode_outer(F.arrays_zip(modal.alias("m"), phrase.alias("p")))).where("_m.m is not null")
    markers = "|".join(CONDITION_MARKERS)
    conditions = F.transform(F.regexp_extract_all("sentence", F.lit(rf"(?i)\b(?:{markers})\b[^,;.]*"), F.lit(0)), trim_all)
    phrase = F.regexp_replace(F.regexp_replace(F.col("_m.p"), rf"(?i),?\s*\b(?:{markers})\b.*$", ""), r"\s*,.*$", "")
    rows = rows.withColumn("conditions", conditions).withColumn("_p", trim_all(phrase)).withColumn("deontic_modality", F.regexp_replace(F.lower(F.regexp_replace(F.col("_m.m"), r"\s+", " ")), "^(is|are) required to$", "is required to"))
    verb = F.lower(F.regexp_extract("_p", r"^(\w+)", 1))
    handed = trim_all(F.regexp_extract("_p", rf"(?i)^\w+\s+(?:that\s+(?:(?:{'|'.join(rules.DETERMINERS)})\s+)?\w+|.*?\bto)\s+(\w.*)$", 1))
    none = F.array().cast("array<string>")
    entry = lambda label, modality, extra: F.struct(label.alias("label"), modality.alias("modality"), F.concat("conditions", extra).alias("conditions"))
    own = F.transform(F.split("_p", r"\s+and\s+(?=[a-z]+\s+(?:the|a|an|its|their|to)\b)"), lambda p: entry(rules.clean_label(p), F.col("deontic_modality"), none))
    passed = lambda extra: F.concat(F.array(entry(rules.clean_label(F.col("_p")), F.col("deontic_modality"), none)), F.filter(F.array(entry(handed, F.lit("shall"), extra)), lambda x: x["label"] != ""))
    every = F.when(verb.isin(DELEGATING_VERBS), passed(none)).when(verb.isin(REQUESTING_VERBS), passed(F.array(F.lit("if requested")))).otherwise(own)
    out = rows.select("doc_id", "at", "_s", "source_article", "source_paragraph", "sentence", F.posexplode_outer(every).alias("_n", "x")).where("x.label <> ''")
    n = (F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "_s", "_n", "x.label")) - 1).alias("n")
    return out.select("doc_id", "at", n, "x.label", rules.deontic_type(F.col("x.modality")).alias("deontic_type"), F.col("x.modality").alias("deontic_modality"), "x.conditions", "source_article", "source_paragraph", "sentence")
