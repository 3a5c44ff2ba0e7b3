"""Scores of predicted organisation charts against gold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import prf
from ..operators import assign
from ..operators.bags import bag_counts
from ..operators.process_graph import numbered
from ..sources.scratch import Scratch
from .evaluation import ENTITY_THRESHOLD, binding_counts, name_pairs, role_coverage


def _names(chart: dict[str, DataFrame], part: str, keys: list[str]) -> DataFrame:
    """Names of units or roles, once each (charts list an entity once for each parent), with their first place."""
    place = F.min("ord") if "ord" in chart[part].columns else F.lit(0)
    return chart[part].groupBy(*keys, "name").agg(place.alias("ord"))


def name_map(found: DataFrame, gold: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, found_name, gold_name of the greedy matches; ties go by place in the chart, then by name."""
    f, g = (numbered(x, keys, ["ord", "name"], n).select(*keys, n, "name") for x, n in ((found, "i"), (gold, "j")))
    matches = assign.greedy(name_pairs(f, g, keys, blank_rule=False, least=threshold), keys, threshold)
    f, g = f.withColumnRenamed("name", "found_name"), g.withColumnRenamed("name", "gold_name")
    return matches.join(f, [*keys, "i"]).join(g, [*keys, "j"]).select(*keys, "found_name", "gold_name")


def _sizes(found: DataFrame, gold: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp, fp, fn; ``hits`` is a row a match, or keys and tp."""
    n = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias(name))
    met = n(gold, "_g").join(n(found, "_f"), keys, "full_outer").join(hits if "tp" in hits.columns else n(hits, "tp"), keys, "left").na.fill(0, ["_g", "_f", "tp"])
    return met.select(*keys, "tp", (F.col("_f") - F.col("tp")).alias("fp"), (F.col("_g") - F.col("tp")).alias("fn"))


def _mapped(rows: DataFrame, column: str, names: DataFrame, keys: list[str], keep_unmapped: bool) -> DataFrame:
    met = rows.join(names.select(*keys, F.col("found_name").alias(column), F.col("gold_name").alias("_to")), [*keys, column], "left")
    return met.withColumn(column, F.coalesce("_to", column) if keep_unmapped else F.col("_to")).drop("_to")


def relations(found: DataFrame, gold: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp, fp, fn of (name, parent) pairs as bags; found names are mapped to gold ones where a match exists."""
    edges = lambda rows: rows.where("parent is not null").select(*keys, "name", "parent")
    mapped = edges(found)
    for end in ("name", "parent"):
        mapped = _mapped(mapped, end, names, keys, True)
    return bag_counts(edges(gold), mapped, keys, ["name", "parent"])


def bindings_by_names(found: DataFrame, gold: DataFrame, units: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp, fp, fn of (unit, role) bindings as bags; a binding with an unmapped name is a false positive."""
    mapped = _mapped(_mapped(found.select(*keys, "unit", "role"), "unit", units, keys, False), "role", roles, keys, False)
    # a binding that maps to nothing takes a value that no gold binding has
    mapped = mapped.select(*keys, F.when(F.col("unit").isNull() | F.col("role").isNull(), F.lit(None)).otherwise(F.struct("unit", "role")).alias("_b"))
    tagged = mapped.select(*keys, F.coalesce(F.to_json("_b"), F.lit("")).alias("_b"))
    return bag_counts(gold.select(*keys, F.to_json(F.struct("unit", "role")).alias("_b")), tagged, keys, ["_b"])


def evaluate(found: dict[str, DataFrame], gold: dict[str, DataFrame], keys: list[str], threshold: float = ENTITY_THRESHOLD) -> DataFrame:
    """keys, aspect, tp, fp, fn, precision, recall, f1: aspects unit, role, actor, unit_hierarchy, role_hierarchy,
    binding_by_names, binding, role_binding, and role_coverage (tp of all gold roles)."""
    units = [_names(x, "units", keys) for x in (found, gold)]
    roles = [_names(x, "roles", keys) for x in (found, gold)]
    # units come before roles; a name of both counts once
    after = lambda rows, n: rows.select(*keys, "name", F.struct(F.lit(n).alias("part"), "ord").alias("ord"))
    actors = [after(u, 0).union(after(r, 1)).groupBy(*keys, "name").agg(F.min("ord").alias("ord")) for u, r in zip(units, roles)]
    unit_map, role_map = name_map(*units, keys, threshold), name_map(*roles, keys, threshold)
    bound = lambda rows, n: numbered(rows, keys, [*(["ord"] if "ord" in rows.columns else []), "subject", "unit", "role"], n).select(*keys, n, "unit", "role")
    # read by five aspects, so numbered once
    scratch = Scratch(found["bindings"].sparkSession)
    f, g = scratch.write(bound(found["bindings"], "i")), scratch.write(bound(gold["bindings"], "j"))
    as_names = lambda rows, n: rows.select(*keys, n, F.col("role").alias("name"))
    covered = role_coverage(as_names(f, "i"), numbered(roles[1], keys, ["ord", "name"], "j"), keys)
    parts = {
        "unit": _sizes(*units, unit_map, keys),
        "role": _sizes(*roles, role_map, keys),
        "actor": _sizes(*actors, name_map(*actors, keys, threshold), keys),
        "unit_hierarchy": relations(found["units"], gold["units"], unit_map, keys),
        "role_hierarchy": relations(found["roles"], gold["roles"], role_map, keys),
        "binding_by_names": bindings_by_names(f, g, unit_map, role_map, keys),
        "binding": _sizes(f, g, binding_counts(f, g, keys, ["unit", "role"]), keys),
        "role_binding": _sizes(f, g, binding_counts(f, g, keys, ["role"]), keys),
        "role_coverage": covered.select(*keys, F.col("covered").alias("tp"), F.lit(0).alias("fp"), (F.col("n_gold") - F.col("covered")).alias("fn")),
    }
    rows = None
    for aspect, counts in parts.items():
        one = counts.select(*keys, F.lit(aspect).alias("aspect"), *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
        rows = one if rows is None else rows.unionByName(one)
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.select(*keys, "aspect", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))
