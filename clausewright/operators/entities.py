"""Entities and hierarchies: units, roles, subjects, fallbacks and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import token_set
from ..sources.scratch import Scratch
from . import name_join

# Fixed value: the unit of roles that belong to none.
EXTERNAL = "External"


def first_of(rows: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """Ordered distinct: the first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def drop_plurals(names: DataFrame, keys: list[str]) -> DataFrame:
    """Drops a name whose singular is there too: the last word without its s or with y for ies, and an acronym of capitals
    without its last S."""
    low = F.lower("name")
    single = F.when(F.col("name").rlike(r"(?:^|\s)\p{Lu}{2,}S$"), F.regexp_replace(low, "s$", ""))
    single = single.when(low.rlike("ies$"), F.regexp_replace(low, "ies$", "y")).when(low.rlike("(ss|us)$"), low).when(low.rlike("s$"), F.regexp_replace(low, "s$", ""))
    marked = names.withColumn("_single", F.when(single != low, single))
    return marked.join(names.select(*keys, F.lower("name").alias("_single")).distinct(), [*keys, "_single"], "left_anti").drop("_single")


def build_entities(actors: DataFrame, relations: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, name, entity_type, parents, unit_parents: UNIT actors are units, all others (BOTH too) roles, in the order
    of ``line_no``; parents in the order of their lines.  ``relations`` is what ``parsing.relation_lines`` gives."""
    kinds = relations.select(key, F.col("child").alias("name"), "relation", F.struct("line_no", "parent").alias("_p"))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("relation") == kind, F.col("_p")))), lambda x: x["parent"])
    listed = kinds.groupBy(key, "name").agg(of("UNIT").alias("_unit"), of("ROLE").alias("_role"), of("ROLE-UNIT").alias("_bound"))
    unit = F.col("actor_type") == "UNIT"
    none = F.array().cast("array<string>")
    rows = actors.join(listed, [key, "name"], "left")
    return rows.select(
        key,
        F.col("line_no").cast("int").alias("ord"),
        "name",
        F.when(unit, "unit").otherwise("role").alias("entity_type"),
        F.coalesce(F.when(unit, F.col("_unit")).otherwise(F.col("_role")), none).alias("parents"),
        F.coalesce(F.when(~unit, F.col("_bound")), none).alias("unit_parents"),
    )


def with_fallback_units(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """The entities, each unit that a role is bound to but that is missing (by name, ``ord`` null), ``External`` as the unit
    of roles that are bound to none and don't bear a unit's name, and External itself where it is used."""
    named = entities.where("entity_type = 'unit'").select(key, "name")
    bound = entities.where("entity_type = 'role'").select(key, F.explode("unit_parents").alias("name"))
    missing = bound.distinct().join(named.distinct(), [key, "name"], "left_anti")
    known = named.union(missing).distinct().withColumn("_known", F.lit(True))
    alone = (F.col("entity_type") == "role") & (F.size("unit_parents") == 0) & F.col("_known").isNull()
    kept = entities.join(known, [key, "name"], "left").withColumn("unit_parents", F.when(alone, F.array(F.lit(EXTERNAL))).otherwise(F.col("unit_parents"))).drop("_known")
    used = kept.where((F.col("entity_type") == "role") & (F.size("unit_parents") == 1) & (F.get("unit_parents", 0) == EXTERNAL)).select(key, F.lit(EXTERNAL).alias("name")).distinct()
    added = missing.union(used.join(known, [key, "name"], "left_anti")).distinct()
    none = F.array().cast("array<string>")
    return kept.unionByName(added.select(key, F.lit(None).cast("int").alias("ord"), "name", F.lit("unit").alias("entity_type"), none.alias("parents"), none.alias("unit_parents")))


def subjects(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, name, uid, unit, role: a subject for each role and unit that it is bound to (those that exist; else the
    unit of its own name, else External).  Dashes and slashes part the words of a role's name; its first and last word
    make the subject's name, two letters of its first two the uid, which counts up in the order of roles and units."""
    units = entities.where("entity_type = 'unit'").groupBy(key).agg(F.collect_set("name").alias("_units"))
    rows = entities.where("entity_type = 'role'").join(units, key, "left").withColumn("_units", F.coalesce("_units", F.array().cast("array<string>")))
    words = F.filter(F.split(F.regexp_replace(F.lower("name"), "[-/]", " "), r"\s+"), lambda w: w != "")
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("role")))
    bound = F.filter("unit_parents", lambda u: F.array_contains(F.col("_units"), u))
    bound = F.when(F.size(bound) > 0, bound).otherwise(F.array(F.when(F.array_contains("_units", F.col("name")), F.col("name")).otherwise(EXTERNAL)))
    rows = rows.select(key, F.col("ord").alias("_o"), F.col("name").alias("role"), words.alias("_w"), F.posexplode(bound).alias("_u", "unit"))
    base = F.concat(F.substring(F.get("_w", 0), 1, 2), F.coalesce(F.substring(F.get("_w", 1), 1, 2), F.lit("")))
    rows = rows.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy(key, "_base").orderBy("_o", "role", "_u"))
    ord_ = (F.row_number().over(Window.partitionBy(key).orderBy("_o", "role", "_u")) - 1).alias("ord")
    name = F.concat(F.get("_w", 0), F.lit("_name "), F.element_at("_w", -1), F.lit("_surname"))
    return rows.withColumn("_n", n).select(key, ord_, name.alias("name"), F.concat("_base", F.when(F.col("_n") == 1, "s").otherwise(F.col("_n").cast("string"))).alias("uid"), "unit", "role")


def resolve_exceptions(tasks: DataFrame, exceptions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, task_no, exc_no, ref_no, shared: an exception that needs a cross-reference goes to the other task whose label and
    conditions share most words with it (first of ties), or to its own where none shares any; all others to their own.
    ``tasks`` has task_no, label, conditions; ``exceptions`` task_no, exc_no, description, needs_cross_ref.  Tasks and
    exceptions meet on shared words, so no pair without one is made."""
    said = F.concat_ws(" ", "label", F.array_join("conditions", " "))
    words = tasks.select(key, F.col("task_no").alias("_t"), F.explode(token_set(said)).alias("_w"))
    asked = exceptions.where("needs_cross_ref").select(key, "task_no", "exc_no", F.explode(token_set(F.col("description"))).alias("_w"))
    scored = asked.join(words, [key, "_w"]).where("task_no <> _t").groupBy(key, "task_no", "exc_no", "_t").agg(F.count("*").alias("n"))
    best = scored.groupBy(key, "task_no", "exc_no").agg(F.max_by("_t", F.struct("n", -F.col("_t"))).alias("ref_no"), F.max("n").alias("shared"))
    return exceptions.join(best, [key, "task_no", "exc_no"], "left").select(key, "task_no", "exc_no", F.coalesce("ref_no", "task_no").alias("ref_no"), F.coalesce("shared", F.lit(0)).alias("shared"))


def hierarchy_edges(units: DataFrame, roles: DataFrame, bindings: DataFrame, key: str = "model_id") -> DataFrame:
    """key, source, target, kind: the edges of a chart's picture.  Of several parents the first counts; edges between
    units and between roles need both ends, those from units to roles a role without a parent; distinct.  ``units`` and
    ``roles`` have name, parent and ord."""
    once = lambda rows: rows.groupBy(key, "name").agg(F.min_by("parent", F.struct(F.col("parent").isNull(), "ord")).alias("parent"))
    u, r = once(units), once(roles)
    inside = lambda rows, kind: rows.where("parent <> ''").select(key, F.col("parent").alias("source"), F.col("name").alias("target"), F.lit(kind).alias("kind")).join(rows.select(key, F.col("name").alias("source")), [key, "source"], "left_semi")
    bare = r.where("parent is null or parent = ''").select(key, F.col("name").alias("target"))
    bound = bindings.select(key, F.col("unit").alias("source"), F.col("role").alias("target"), F.lit("binding").alias("kind")).distinct()
    bound = bound.join(bare, [key, "target"], "left_semi").join(u.select(key, F.col("name").alias("source")), [key, "source"], "left_semi")
    return inside(u, "unit").unionByName(inside(r, "role")).unionByName(bound).select(key, "source", "target", "kind")


def relation_text(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, line: the lines ``CHILD | PARENT | TYPE`` of entities in their order (those without one last, by name)."""
    kind = F.when(F.col("entity_type") == "unit", "UNIT").otherwise("ROLE")
    pairs = lambda column, relation: F.transform(F.col(column), lambda p: F.concat_ws(" | ", "name", p, relation))
    rows = entities.select(key, F.struct(F.col("ord").isNull().alias("late"), "ord", "name").alias("_o"), F.posexplode(F.concat(pairs("parents", kind), pairs("unit_parents", F.lit("ROLE-UNIT")))).alias("_n", "line"))
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_o", "_n")) - 1).alias("ord"), "line")


def performer_names(subjects: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, known, unit, role: subjects (unit, role, subject_no) under their unit's and role's lower-case names, unit
    first; ``ord`` is where the name occurs first."""
    rows = subjects.select(key, "unit", "role", F.posexplode(F.array(F.lower("unit"), F.lower("role"))).alias("_side", "known"), "subject_no").where("known <> ''")
    first = F.min(F.col("subject_no") * 2 + F.col("_side")).over(Window.partitionBy(key, "known"))
    return rows.withColumn("ord", first).select(key, "ord", "known", "unit", "role").distinct()


def resolve_performers(wanted: DataFrame, subjects: DataFrame, key: str = "doc_id") -> DataFrame:
    """wanted (key, task_no, text) with unit and role: all subjects under the first known name that equals the text, holds it
    or is held by it, without case; the text itself as unit and role where none does.  Texts and names meet by ``name_join.holding``."""
    names = Scratch(subjects.sparkSession).write(performer_names(subjects, key))
    texts = wanted.select(key, "text").distinct()
    low = F.lower(F.trim("text"))
    met = name_join.holding(texts.select(key, low.alias("_low")), names.select(key, "known"), [key], "_low", "known")
    close = texts.withColumn("_low", low).join(met.hint("merge"), [key, "_low"]).join(names.select(key, "ord", "known").distinct().hint("merge"), [key, "known"])
    best = close.groupBy(key, "text").agg(F.min_by("known", F.struct("ord", "known")).alias("known"))
    met = wanted.join(best.hint("merge"), [key, "text"], "left").join(names.select(key, "known", "unit", "role").hint("merge"), [key, "known"], "left")
    return met.select(key, "task_no", "text", F.coalesce("unit", "text").alias("unit"), F.coalesce("role", "text").alias("role")).distinct()


def task_performers(tasks: DataFrame, subjects: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, task_no, ord, unit, role: what ``parsing.performers`` found in the tasks, open texts looked up; each pair once a task, in
    the order of the text, the subjects of one open text by unit and role."""
    said = tasks.select(key, "task_no", F.posexplode("performers").alias("_at", "p")).select(key, "task_no", "_at", "p.*")
    said = Scratch(tasks.sparkSession).write(said)  # read by many branches
    open_ = said.where("unit is null")
    looked_up = resolve_performers(open_.select(key, "task_no", "text"), subjects, key).join(open_.select(key, "task_no", "text", "_at").hint("merge"), [key, "task_no", "text"])
    every = said.where("unit is not null").select(key, "task_no", "_at", "unit", "role").unionByName(looked_up.select(key, "task_no", "_at", "unit", "role"))
    first = every.groupBy(key, "task_no", "unit", "role").agg(F.min("_at").alias("_at"))
    place = F.row_number().over(Window.partitionBy(key, "task_no").orderBy("_at", "unit", "role")) - 1
    return first.select(key, "task_no", place.alias("ord"), "unit", "role")
