"""Completeness and correctness of process diagrams: gold-order matching of names, pairs and splits.

The candidates of a diagram pair come from an equi-join on the keys, so a pair of diagrams never meets another;
similarities are computed once for each distinct pair of names of a join.  Element tables are read by many branches of a plan, so each is
written once to the shared folder first, and XML behind it is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.similarity import trigram_cosine_of
from ..operators import assign, name_join, process_graph
from ..sources.scratch import Scratch

# Thresholds.
COMPLETENESS = {"actors": 0.70, "activities": 0.50, "events": 0.55, "data_objects": 0.60, "conditions": 0.60}
CORRECTNESS = {"activities": 0.50, "conditions": 0.50, "actors": 0.70}


def vector_similarity(a: Column, b: Column) -> Column:
    """The plain cosine of the names' vectors, without shortcuts."""
    return trigram_cosine_of(F.lower(a), F.lower(b))


def _written(found: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(found.sparkSession)
    return scratch.write(found), scratch.write(gold)


def _sides(found: DataFrame, gold: DataFrame, keys: list[str], columns: list[str], similarity) -> tuple[DataFrame, DataFrame]:
    """Both sides' names, without case where the similarity is without case."""
    name = lambda c: F.lower(c) if similarity is vector_similarity and c != "labels" else F.col(c)
    left = found.select(*keys, "i", *[name(c).alias(f"f_{c}") for c in columns])
    return left, gold.select(*keys, "j", *[name(c).alias(f"g_{c}") for c in columns])


def _alike(left: DataFrame, right: DataFrame, keys: list[str], column: str, out: str, least, similarity) -> DataFrame:
    """keys, f_column, g_column, out: the distinct names of a pair of diagrams that are similar enough; a pair of names
    that many diagrams have is scored once.  By the default similarity names meet on rare trigrams, above the smallest threshold there is."""
    names = [f"f_{column}", f"g_{column}"]
    if similarity is vector_similarity:
        floor = least if isinstance(least, float) else min(COMPLETENESS.values())
        return name_join.alike(left, right, keys, *names, floor, contained=False).withColumnRenamed("score", out).where(F.col(out) >= least)
    met = left.select(*keys, names[0]).distinct().join(right.select(*keys, names[1]).distinct(), keys)
    scored = met.select(*names).distinct().withColumn(out, similarity(*map(F.col, names)))
    return met.join(scored, names).where(F.col(out) >= least)


def _counts(found: DataFrame, gold: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias(name))
    return n(gold, "n_gold").join(n(found, "n_found"), keys, "full_outer").join(n(matches, "matched"), keys, "left").na.fill(0, ["n_gold", "n_found", "matched"])


def completeness(found: DataFrame, gold: DataFrame, keys: list[str], similarity=vector_similarity) -> DataFrame:
    """keys, kind, n_gold, n_found, matched, recall, precision of the names of two element tables.  No gold names:
    recall 1; no found names: recall 0 (precision the other way round)."""
    listed = lambda rows: process_graph.element_names(rows, keys).groupBy(*keys, "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    return completeness_of_names(*map(listed, _written(found, gold)), keys, similarity)


def completeness_of_names(found: DataFrame, gold: DataFrame, keys: list[str], similarity=vector_similarity) -> DataFrame:
    """The same of two tables (keys, kind, names) with a row a diagram and kind: they meet in one join, and names are matched in its
    rows.  By the default similarity alike names come from a join on rare trigrams, so the tables are written first."""
    all_keys = [*keys, "kind"]
    cased = F.transform("names", F.lower) if similarity is vector_similarity else F.col("names")
    least = F.element_at(F.create_map(*[F.lit(x) for pair in COMPLETENESS.items() for x in pair]), F.col("kind"))
    if similarity is vector_similarity:
        found, gold = _written(found, gold)
    f, g = found.select(*all_keys, cased.alias("_f")), gold.select(*all_keys, cased.alias("_g"))
    met = g.join(f, all_keys, "full_outer")
    if similarity is vector_similarity:
        left, right = (side.select(*all_keys, F.explode(c).alias(f"{c[1]}_name")) for side, c in ((f, "_f"), (g, "_g")))
        close = _alike(left, right, all_keys, "name", "score", least, similarity)
        close = close.groupBy(*all_keys).agg(F.collect_list(F.struct(F.col("f_name").alias("f"), F.col("g_name").alias("g"), "score")).alias("_close"))
        met = met.join(close, all_keys, "left")
    else:
        pair = lambda x, y: F.struct(x.alias("f"), y.alias("g"), similarity(x, y).cast("double").alias("score"))
        pairs = F.flatten(F.transform(F.array_distinct("_f"), lambda x: F.transform(F.array_distinct("_g"), lambda y: pair(x, y))))
        met = met.withColumn("_close", F.filter(pairs, lambda c: (c["score"] >= least) & (c["score"] >= 0)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    met = met.withColumn("_f", F.coalesce("_f", none)).withColumn("_g", F.coalesce("_g", none))
    rows = assign.gold_order_counts(met, "_f", "_g", "_close", "matched").select(*all_keys, size("_g").alias("n_gold"), size("_f").alias("n_found"), "matched")
    part = lambda whole, other: F.when(F.col(whole) == 0, 1.0).when(F.col(other) == 0, 0.0).otherwise(F.col("matched") / F.nullif(F.col(whole), F.lit(0)))
    return rows.withColumn("recall", part("n_gold", "n_found")).withColumn("precision", part("n_found", "n_gold"))


def _scored_share(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", metrics.recall_or_null(F.col("n_gold"), F.col("n_found"), F.col("matched")))


def _pair_correctness(found: DataFrame, gold: DataFrame, keys: list[str], columns: tuple[str, str], least: tuple[float, float], similarity) -> tuple[DataFrame, DataFrame]:
    f, g = process_graph.numbered(found, keys, ["ord"], "i"), process_graph.numbered(gold, keys, ["ord"], "j")
    left, right = _sides(f, g, keys, list(columns), similarity)
    met = left
    for n, c in enumerate(columns):
        met = met.join(_alike(left, right, keys, c, f"_s{n}", least[n], similarity), [*keys, f"f_{c}"])
    met = met.join(right, [*keys, *[f"g_{c}" for c in columns]])  # pairs meet where both names are alike
    matches = assign.gold_order(met.withColumn("score", (F.col("_s0") + F.col("_s1")) / 2), keys, 0.0)
    return matches, _scored_share(_counts(f, g, matches, keys))


def actor_assignment(found: DataFrame, gold: DataFrame, keys: list[str], similarity=vector_similarity) -> DataFrame:
    """keys, n_gold, n_found, matched, score over (activity, actor) pairs: both names must be similar enough; null
    where neither diagram has any."""
    sides = [process_graph.activity_actors(x, keys) for x in _written(found, gold)]
    return _pair_correctness(*sides, keys, ("activity", "actor"), (CORRECTNESS["activities"], CORRECTNESS["actors"]), similarity)[1]


def control_flow(found: DataFrame, gold: DataFrame, keys: list[str], similarity=vector_similarity) -> DataFrame:
    """The same over (source, target) pairs of named nodes."""
    sides = [process_graph.control_flow(x, keys) for x in _written(found, gold)]
    return _pair_correctness(*sides, keys, ("source", "target"), (CORRECTNESS["activities"],) * 2, similarity)[1]


def control_flow_of_pairs(found: DataFrame, gold: DataFrame, keys: list[str], similarity=vector_similarity) -> DataFrame:
    """The same of two tables (keys, pairs) with a row a diagram: they meet in one join, and pairs are matched in its rows.  By the default
    similarity alike names come from joins on rare trigrams, so the tables are written first."""
    cased = F.lower if similarity is vector_similarity else lambda c: c
    ends, least = ("source", "target"), CORRECTNESS["activities"]
    if similarity is vector_similarity:
        found, gold = _written(found, gold)
    f, g = (side.select(*keys, F.transform("pairs", lambda p: F.struct(*[cased(p[c]).alias(c) for c in ends])).alias(n)) for side, n in ((found, "_f"), (gold, "_g")))
    met = g.join(f, keys, "full_outer")
    for c in ends:
        if similarity is vector_similarity:
            left, right = (side.select(*keys, F.explode(f"{n}.{c}").alias(f"{n[1]}_{c}")) for side, n in ((f, "_f"), (g, "_g")))
            close = _alike(left, right, keys, c, "score", least, similarity)
            met = met.join(close.groupBy(*keys).agg(F.collect_list(F.struct(F.col(f"f_{c}").alias("f"), F.col(f"g_{c}").alias("g"), "score")).alias(f"_{c}")), keys, "left")
        else:
            pair = lambda x, y: F.struct(x.alias("f"), y.alias("g"), similarity(x, y).cast("double").alias("score"))
            pairs = F.flatten(F.transform(F.array_distinct(f"_f.{c}"), lambda x: F.transform(F.array_distinct(f"_g.{c}"), lambda y: pair(x, y))))  # noqa: B023
            met = met.withColumn(f"_{c}", F.filter(pairs, lambda p: p["score"] >= least))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    none = F.array().cast("array<struct<source:string,target:string>>")
    met = met.withColumn("_f", F.coalesce("_f", none)).withColumn("_g", F.coalesce("_g", none))
    rows = assign.gold_order_pair_counts(met, "_f", "_g", [f"_{c}" for c in ends], "matched")
    return _scored_share(rows.select(*keys, size("_g").alias("n_gold"), size("_f").alias("n_found"), "matched"))


def decision_logic(found: DataFrame, gold: DataFrame, keys: list[str], similarity=vector_similarity) -> DataFrame:
    """The same over decision splits: gateway names must be similar enough; a candidate's score is the mean of that
    similarity and the share of gold labels that find a partner among its labels."""
    found, gold = _written(found, gold)
    f = process_graph.numbered(process_graph.decision_splits(found, keys), keys, ["ord"], "i")
    g = process_graph.numbered(process_graph.decision_splits(gold, keys), keys, ["ord"], "j")
    left, right = _sides(f, g, keys, ["name", "labels"], similarity)
    close = _alike(left, right, keys, "name", "_gate", CORRECTNESS["conditions"], similarity)
    met = left.join(close, [*keys, "f_name"]).join(right, [*keys, "g_name"])
    # each pair of label lists is compared once, however many gates have it
    inner = ["f_labels", "g_labels"]
    lists = met.select(*inner).distinct()
    listed = lists.select(*inner, F.posexplode("f_labels").alias("i", "f_label"))
    listed = listed.select(*inner, "i", "f_label", F.posexplode("g_labels").alias("j", "g_label"))
    names = ["f_label", "g_label"]
    labels = listed.join(listed.select(*names).distinct().withColumn("score", similarity(*map(F.col, names))), names)
    hits = assign.gold_order(labels, inner, CORRECTNESS["conditions"]).groupBy(*inner).agg(F.count("*").alias("_hits"))
    share = F.coalesce("_hits", F.lit(0)) / F.size("g_labels")
    scored = met.join(hits, inner, "left").select(*keys, "i", "j", ((F.col("_gate") + share) / 2).alias("score"))
    return _scored_share(_counts(f, g, assign.gold_order(scored, keys, 0.0), keys))


def match_details(found: DataFrame, gold: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, details: a line a match (best first), then the missing gold names, then the extra found names."""
    f, g = found.select(*keys, "i", F.col("name").alias("f_name")), gold.select(*keys, "j", F.col("name").alias("g_name"))
    hit = matches.join(f, [*keys, "i"]).join(g, [*keys, "j"]).select(*keys, F.lit(0).alias("_part"), (-F.col("score")).alias("_at"), F.format_string("MATCH: '%s' with '%s' (%.2f)", "g_name", "f_name", "score").alias("_line"))
    missing = assign.unmatched(g, matches, keys, "j").select(*keys, F.lit(1).alias("_part"), F.col("j").cast("double").alias("_at"), F.format_string("MISSING: '%s'", "g_name").alias("_line"))
    extra = assign.unmatched(f, matches, keys, "i").select(*keys, F.lit(2).alias("_part"), F.col("i").cast("double").alias("_at"), F.format_string("EXTRA: '%s'", "f_name").alias("_line"))
    lines = F.array_sort(F.collect_list(F.struct("_part", "_at", "_line")))
    return hit.unionByName(missing).unionByName(extra).groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("details"))
