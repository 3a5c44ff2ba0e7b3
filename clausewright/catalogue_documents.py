"""Registered queries over whole documents: diagrams, charts, task tables, rewriting, candidates, reports, with oracles.

Inputs are made from all rows of the driver's tables.  Names of charts and task tables are hashes, and found ones differ from gold
ones in their last letters, so that an oracle can say which are alike enough; diagrams are compared by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _ACTOR, _MODAL, _OTHER, _PRF_SQL, _SAYS, _WHERE, query, read, regulations, similarity_sql
from .functions import rewriting, rules
from .operators import assembly, candidates, completion, entities, parsing, process_graph, references, testset
from .plans import description_evaluation, organigram_evaluation, process_evaluation, reports, task_evaluation
from .sources import documents, sinks
from .sources.scratch import Scratch

# --- diagrams: a customer is a process, an order a task that leads to the next, its lines labelled flows ---------
KEYS = ["model_id"]


def _diagrams(spark: SparkSession, sf_dir: str, kept: str = "true") -> DataFrame:
    """Process XML of every customer with orders."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<sequenceFlow id="f'), "l_orderkey", F.lit("-"), "l_linenumber", F.lit('" name="'), F.trim("l_returnflag"), F.lit('" sourceRef="g'), "l_orderkey", F.lit('" targetRef="n'), "l_orderkey", F.lit('"/>')))), "").alias("flows"))
    rows = read(spark, sf_dir, "orders").where(kept).join(lines, "o_orderkey", "left")
    node = F.concat(F.lit('<task id="n'), "o_orderkey", F.lit('" name="'), F.trim("o_orderpriority"), F.lit('"/><exclusiveGateway id="g'), "o_orderkey", F.lit('" name="gate '), F.trim("o_orderpriority"), F.lit('"/>'), F.coalesce("flows", F.lit("")))
    one = rows.groupBy(F.col("o_custkey").alias("model_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", node.alias("x"), F.col("o_orderstatus").alias("s")))).alias("o"))
    follow = F.transform(F.arrays_zip(F.expr("slice(o, 1, size(o) - 1)").alias("a"), F.slice("o", 2, 1 << 20).alias("b")), lambda p: F.concat(F.lit('<sequenceFlow id="s'), p["a"]["o_orderkey"], F.lit('" sourceRef="n'), p["a"]["o_orderkey"], F.lit('" targetRef="n'), p["b"]["o_orderkey"], F.lit('"/>')))
    lane = F.array_join(F.transform(F.filter("o", lambda x: x["s"] == "F"), lambda x: F.concat(F.lit("<flowNodeRef>n"), x["o_orderkey"], F.lit("</flowNodeRef>"))), "")
    body = F.array_join(F.transform("o", lambda x: x["x"]), "")
    xml = F.concat(F.lit('<definitions xmlns="http://example.org/bpmn"><collaboration><participant id="p" name="Pool" processRef="pr"/></collaboration><process id="pr"><laneSet id="ls"><lane id="l" name="Finished">'), lane, F.lit("</lane></laneSet>"), body, F.array_join(follow, ""), F.lit("</process></definitions>"))
    return one.select("model_id", xml.alias("xml"))


def _elements(spark: SparkSession, sf_dir: str, kept: str = "true") -> DataFrame:
    return documents.bpmn_elements(_diagrams(spark, sf_dir, kept))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element table for queries that read it more than once: XML is put together and parsed once."""
    return Scratch(spark).write(_elements(spark, sf_dir))


_FLOW_SQL = """SELECT o_custkey AS model_id, p AS source, n AS target FROM (SELECT o_custkey, trim(o_orderpriority) AS p, lead(trim(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders}) WHERE n IS NOT NULL
    UNION ALL SELECT o_custkey, 'gate ' || trim(o_orderpriority), trim(o_orderpriority) FROM {orders} JOIN lineitem ON l_orderkey = o_orderkey"""
_ACTOR_SQL = "SELECT o_custkey AS model_id, trim(o_orderpriority) AS activity, CASE WHEN o_orderstatus = 'F' THEN 'Finished' ELSE 'Pool' END AS actor FROM {orders}"
_FOUND = "o_orderkey % 3 <> 0"
_SUBSET = f"(SELECT * FROM orders WHERE {_FOUND})"


@query("""SELECT o_custkey AS model_id, count(*) AS activities, 0 AS events, count(*) AS gateways, sum(coalesce(n, 0))::BIGINT + count(*) - 1 AS edges, 1 AS roles
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""")
def s10_s12_element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.bpmn_counts(_elements(spark, sf_dir), "model_id")


@query("""SELECT o_custkey AS model_id, 'activities' AS kind, string_agg(DISTINCT trim(o_orderpriority), ';' ORDER BY trim(o_orderpriority)) AS names FROM orders GROUP BY 1
    UNION ALL SELECT DISTINCT o_custkey, 'actors', 'Finished;Pool' FROM orders
    UNION ALL SELECT o_custkey, 'conditions', string_agg(DISTINCT 'gate ' || trim(o_orderpriority), ';' ORDER BY 'gate ' || trim(o_orderpriority)) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) GROUP BY 1""")
def s11_s13_element_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = process_graph.diagram_names(_diagrams(spark, sf_dir))
    return names.select("model_id", "kind", F.array_join(F.array_sort(F.array_distinct("names")), ";").alias("names"))


@query("""SELECT o_custkey AS model_id, 'exclusiveGateway' AS tag, count(*) AS n_branching FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) GROUP BY 1""")
def j3_branchings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_graph.branchings(_written(spark, sf_dir), KEYS)


@query(f"SELECT model_id, source, target, count(*) AS n FROM ({_FLOW_SQL.format(orders='orders')}) GROUP BY ALL")
def j4_control_flow_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_graph.control_flow(_written(spark, sf_dir), KEYS).groupBy("model_id", "source", "target").agg(F.count("*").alias("n"))


@query(f"SELECT model_id, activity, actor, count(*) AS n FROM ({_ACTOR_SQL.format(orders='orders')}) GROUP BY ALL")
def j5_activity_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_graph.activity_actors(_written(spark, sf_dir), KEYS).groupBy("model_id", "activity", "actor").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS model_id, 'gate ' || trim(o_orderpriority) AS name, labels, count(*) AS n
    FROM (SELECT l_orderkey, string_agg(trim(l_returnflag), ';' ORDER BY trim(l_returnflag)) AS labels FROM lineitem GROUP BY 1 HAVING count(*) > 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def j6_decision_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = process_graph.decision_splits(_written(spark, sf_dir), KEYS)
    return rows.groupBy("model_id", "name", F.array_join("labels", ";").alias("labels")).agg(F.count("*").alias("n"))


def _same(a, b):
    return (a == b).cast("double")


def _bag_share(pairs: str, columns: str) -> str:
    gold, found = pairs.format(orders="orders"), pairs.format(orders=_SUBSET)
    return f"""WITH g AS (SELECT model_id, {columns}, count(*) AS n FROM ({gold}) GROUP BY ALL), f AS (SELECT model_id, {columns}, count(*) AS m FROM ({found}) GROUP BY ALL),
    x AS (SELECT model_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM g FULL JOIN f USING (model_id, {columns}))
    SELECT model_id, sum(n)::BIGINT AS n_gold, sum(m)::BIGINT AS n_found, sum(least(n, m))::BIGINT AS matched,
        round(CASE WHEN sum(n) = 0 THEN CASE WHEN sum(m) = 0 THEN NULL ELSE 1.0 END WHEN sum(m) = 0 THEN 0.0 ELSE sum(least(n, m))::DOUBLE / sum(n) END, 9) AS score FROM x GROUP BY 1"""


def _scored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.round("score", 9))


@query(_bag_share(_ACTOR_SQL, "activity, actor"))
def j25_actor_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With equality as the similarity the matching is a bag intersection, which SQL can say."""
    return _scored(process_evaluation.actor_assignment(_elements(spark, sf_dir, _FOUND), _elements(spark, sf_dir), KEYS, _same))


@query(_bag_share(_FLOW_SQL, "source, target"))
def j26_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, gold = (process_graph.diagram_flows(_diagrams(spark, sf_dir, kept)) for kept in (_FOUND, "true"))
    return _scored(process_evaluation.control_flow_of_pairs(found, gold, KEYS, _same))


_SPLIT_SQL = "SELECT o_custkey AS model_id, 'gate ' || trim(o_orderpriority) AS name FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)"


@query(_bag_share(_SPLIT_SQL, "name"))
def j27_decision_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With equality a gate has a partner as long as one of its name is left, whatever the labels say."""
    return _scored(process_evaluation.decision_logic(_elements(spark, sf_dir, _FOUND), _elements(spark, sf_dir), KEYS, _same))


_NAME_SQL = f"""SELECT o_custkey AS model_id, 'activities' AS kind, trim(o_orderpriority) AS name FROM {{orders}} UNION ALL SELECT DISTINCT o_custkey, 'actors', unnest(['Pool', 'Finished']) FROM {{orders}}
    UNION ALL SELECT model_id, 'conditions', name FROM ({_SPLIT_SQL})"""


@query(f"""WITH g AS (SELECT model_id, kind, name, count(*) AS n FROM ({_NAME_SQL.format(orders='orders')}) GROUP BY ALL), f AS (SELECT model_id, kind, name, count(*) AS m FROM ({_NAME_SQL.format(orders=_SUBSET)}) GROUP BY ALL),
    x AS (SELECT model_id, kind, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM g FULL JOIN f USING (model_id, kind, name)), s AS (SELECT model_id, kind, sum(n)::BIGINT AS n_gold, sum(m)::BIGINT AS n_found, sum(least(n, m))::BIGINT AS matched FROM x GROUP BY ALL)
    SELECT *, round(CASE WHEN n_gold = 0 THEN 1.0 WHEN n_found = 0 THEN 0.0 ELSE matched::DOUBLE / n_gold END, 9) AS recall, round(CASE WHEN n_found = 0 THEN 1.0 WHEN n_gold = 0 THEN 0.0 ELSE matched::DOUBLE / n_found END, 9) AS precision FROM s""")
def j23_j24_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, gold = (process_graph.diagram_names(_diagrams(spark, sf_dir, kept)) for kept in (_FOUND, "true"))
    rows = process_evaluation.completeness_of_names(found, gold, KEYS, _same)
    return rows.withColumn("recall", F.round("recall", 9)).withColumn("precision", F.round("precision", 9))


# --- charts and task tables ---------------------------------------------------------------------------------------
def _other(name: str, found: bool) -> str:
    """A found name differs from the gold one in its last letters: 0.88 alike, and no other name comes near."""
    return f"concat(substr({name}, 1, 30), 'zz')" if found else name


def _chart(spark: SparkSession, sf_dir: str, kept: str) -> dict[str, DataFrame]:
    found = kept != "true"
    names = {"unit": "md5(trim(c_mktsegment))", "role": "md5(CAST(c_nationkey AS STRING))"}
    rows = read(spark, sf_dir, "customer").where(kept).selectExpr("c_custkey % 97 AS model_id", *[f"{_other(x, found)} AS {n}" for n, x in names.items()], "CASE WHEN c_nationkey <> 0 THEN md5('0') END AS chief", "CAST(c_custkey AS STRING) AS subject")
    return {
        "units": rows.select("model_id", F.col("unit").alias("name"), F.lit(None).cast("string").alias("parent")),
        "roles": rows.select("model_id", F.col("role").alias("name"), F.col("chief").alias("parent")),
        "bindings": rows.select("model_id", "subject", "unit", "role"),
    }


_CHART_SQL = """WITH g AS (SELECT c_custkey % 97 AS model_id, trim(c_mktsegment) AS u, c_nationkey AS r FROM customer), f AS (SELECT c_custkey % 97 AS model_id, trim(c_mktsegment) AS u, c_nationkey AS r FROM customer WHERE c_custkey % 3 <> 0),
    e(model_id, aspect, k, n, m) AS (
        SELECT model_id, 'unit', u, count(DISTINCT s) FILTER (s = 1), count(DISTINCT s) FILTER (s = 2) FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f) GROUP BY model_id, u
        UNION ALL SELECT model_id, 'role', r::VARCHAR, count(DISTINCT s) FILTER (s = 1), count(DISTINCT s) FILTER (s = 2) FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f) GROUP BY model_id, r
        UNION ALL SELECT model_id, 'binding', u || r, count(*) FILTER (s = 1), count(*) FILTER (s = 2) FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f) GROUP BY ALL
        UNION ALL SELECT model_id, 'binding_by_names', u || r, count(*) FILTER (s = 1), count(*) FILTER (s = 2) FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f) GROUP BY ALL
        UNION ALL SELECT model_id, 'role_binding', r::VARCHAR, count(*) FILTER (s = 1), count(*) FILTER (s = 2) FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f) GROUP BY ALL)
    SELECT model_id, aspect, sum(least(n, m))::BIGINT AS tp, sum(m - least(n, m))::BIGINT AS fp, sum(n - least(n, m))::BIGINT AS fn FROM e GROUP BY ALL"""
#: The other aspects: units and roles together, role -> chief edges as bags (one for each row that names them), gold roles that are bound.
_HIERARCHY_SQL = _CHART_SQL.replace("UNION ALL SELECT model_id, 'binding', u || r", """UNION ALL SELECT model_id, 'actor', x, count(DISTINCT s) FILTER (s = 1), count(DISTINCT s) FILTER (s = 2) FROM (SELECT model_id, unnest([u, r::VARCHAR]) AS x, s FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f)) GROUP BY model_id, x
        UNION ALL SELECT model_id, 'role_hierarchy', r::VARCHAR, count(*) FILTER (s = 1), count(*) FILTER (s = 2) FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f) WHERE r <> 0 GROUP BY model_id, r
        UNION ALL SELECT model_id, 'role_coverage', r::VARCHAR, 1, max(CASE WHEN s = 2 THEN 1 ELSE 0 END) FROM (SELECT *, 1 AS s FROM g UNION ALL SELECT *, 2 FROM f) GROUP BY model_id, r
        UNION ALL SELECT model_id, 'binding', u || r""", 1)


@query(_CHART_SQL)
def j15_j18_chart_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = organigram_evaluation.evaluate(_chart(spark, sf_dir, "c_custkey % 3 <> 0"), _chart(spark, sf_dir, "true"), KEYS)
    return rows.where(F.col("aspect").isin("unit", "role", "binding", "binding_by_names", "role_binding")).select("model_id", "aspect", "tp", "fp", "fn")


@query(f"SELECT model_id, aspect, tp, fp, fn, {_PRF_SQL} FROM ({_HIERARCHY_SQL})")
def j28_j29_hierarchy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organigram_evaluation.evaluate(_chart(spark, sf_dir, "c_custkey % 3 <> 0"), _chart(spark, sf_dir, "true"), KEYS)


def _task_table(spark: SparkSession, sf_dir: str, found: bool) -> DataFrame:
    changed = "o_orderkey % 4 = 0" if found else "false"
    rows = read(spark, sf_dir, "orders").where(_FOUND if found else "true").selectExpr(
        "o_custkey AS model_id", "o_orderkey", f"{_other('md5(CAST(o_orderkey AS STRING))', found)} AS label", "CAST(o_orderkey AS STRING) AS task_id",
        f"array(named_struct('unit', {_other("md5(concat('Clerk ', o_custkey))", found)}, 'role', {_other('md5(o_orderpriority)', found)})) AS performers",
        f"CASE WHEN {changed} THEN 'changed' ELSE o_orderstatus END AS deontic_type", "'shall' AS deontic_modality",
        f"CASE WHEN {changed} THEN CAST(array() AS array<string>) ELSE array({_other("md5(concat(o_orderkey, 'c'))", found)}) END AS conditions",
        f"CASE WHEN {changed} OR o_orderkey % 2 = 0 THEN CAST(array() AS array<struct<_VALUE:string,_description:string,_ref:string>>) ELSE array(named_struct('_VALUE', CAST(NULL AS STRING), '_description', {_other("md5(concat(o_orderkey, 'e'))", found)}, '_ref', CAST(NULL AS STRING))) END AS exceptions",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '1' END AS source_article", "'2' AS source_paragraph")
    return process_graph.numbered(rows, KEYS, ["o_orderkey"], "ord")


@query(f"""WITH r AS (SELECT o_custkey AS model_id, CASE WHEN {_FOUND} THEN 1 ELSE 0 END AS hit, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS other, o_orderkey % 2 AS odd FROM orders),
    s AS (SELECT model_id, count(*) AS n, sum(hit) AS h, sum(hit * other) AS bad, sum(odd) AS eg, sum(odd * hit) AS ef FROM r GROUP BY 1)
    SELECT model_id, n AS gold_tasks, h::BIGINT AS pred_tasks, h::BIGINT AS matched_tasks, round(h::DOUBLE / n, 4) AS performer_correctness,
        CASE WHEN h = 0 THEN 0.0 ELSE round((h - bad)::DOUBLE / h, 4) END AS deontic_micro_precision, round((h - bad)::DOUBLE / n, 4) AS deontic_micro_recall,
        CASE WHEN h - bad = 0 THEN 0.0 ELSE 1.0 END AS condition_micro_precision, round((h - bad)::DOUBLE / n, 4) AS condition_micro_recall,
        CASE WHEN h = 0 THEN 0.0 ELSE round((h - bad)::DOUBLE / h, 4) END AS deontic_macro_f1,
        CASE WHEN eg = 0 THEN 1.0 WHEN ef = 0 THEN 0.0 ELSE 1.0 END AS exception_micro_precision, CASE WHEN eg = 0 THEN 1.0 ELSE round(ef::DOUBLE / eg, 4) END AS exception_micro_recall FROM s""")
def a3_a5_j19_j21_task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = task_evaluation.evaluate(_task_table(spark, sf_dir, True), _task_table(spark, sf_dir, False), KEYS)
    return rows.select("model_id", "gold_tasks", "pred_tasks", "matched_tasks", "performer_correctness", "deontic_micro_precision", "deontic_micro_recall", "condition_micro_precision", "condition_micro_recall", "deontic_macro_f1", "exception_micro_precision", "exception_micro_recall")


_GOLD_TEXT = "concat('The process has the following actors: Commission, importer and operator. The Commission shall file record ', o_orderkey, '. The importer may close record ', o_orderkey, '; The operator must not wait. If late, all stop.')"
_FOUND_TEXT = """CASE o_orderkey % 4 WHEN 0 THEN concat('The process has the following actors: Commission, importer and operator. The Commission shall file record ', o_orderkey, '. The importer may close record ', o_orderkey, '; The operator must not wait. If late, all stop.')
    WHEN 1 THEN concat('The process has the following actors: Commission and clerk. The Commission must file record ', o_orderkey, '. The importer may close record ', o_orderkey, '.')
    WHEN 2 THEN concat('The Commission shall file record ', o_orderkey, '. The importer may vote. If late, or unless told, stop.')
    ELSE concat('The process has the following actors: Commission and the importers. The Commission shall file the record ', o_orderkey, '. The importer should vote.') END"""
_TOKENS_SQL = r"len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]'))"
_FILED = ("'file the record ' || o_orderkey", "'file record ' || o_orderkey")


@query(f"""WITH t AS (SELECT *, {_GOLD_TEXT} AS gold, {_FOUND_TEXT} AS found, o_orderkey % 4 AS k, {similarity_sql(*_FILED)} AS s FROM orders),
    c AS (SELECT *, {_TOKENS_SQL.format("gold")} AS gold_total_tokens, {_TOKENS_SQL.format("found")} AS pred_total_tokens, CASE WHEN k IN (1, 2) THEN 3 WHEN k = 0 THEN 4 ELSE 3 END AS pred_total_sentences,
        CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 1 END AS matched_tasks, CASE k WHEN 0 THEN 3 ELSE 2 END AS pred_task_count FROM t)
    SELECT o_orderkey AS doc_id, 3 AS gold_actor_count, CASE k WHEN 0 THEN 3 WHEN 2 THEN 0 ELSE 2 END AS pred_actor_count, (CASE k WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0 ELSE 1 END)::DOUBLE AS actor_precision,
        (CASE k WHEN 0 THEN 1 WHEN 1 THEN 0.3333 WHEN 2 THEN 0 ELSE 0.6667 END)::DOUBLE AS actor_recall, 3 AS gold_task_count, pred_task_count, matched_tasks, round(matched_tasks::DOUBLE / pred_task_count, 4) AS task_precision, round(matched_tasks::DOUBLE / 3, 4) AS task_recall,
        (CASE k WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0.5 END)::DOUBLE AS deontic_precision, (CASE k WHEN 0 THEN 1 ELSE 0.3333 END)::DOUBLE AS deontic_recall,
        CASE k WHEN 3 THEN round(s, 4) ELSE 1.0::DOUBLE END AS avg_task_similarity, 4 AS gold_total_sentences, pred_total_sentences, gold_total_tokens::INTEGER AS gold_total_tokens, pred_total_tokens::INTEGER AS pred_total_tokens,
        round(gold_total_tokens::DOUBLE / 4, 4) AS gold_avg_tokens_per_sentence, round(pred_total_tokens::DOUBLE / pred_total_sentences, 4) AS pred_avg_tokens_per_sentence, round(pred_total_tokens::DOUBLE / pred_total_sentences, 4) AS pred_tokens_per_sentence,
        (CASE k WHEN 0 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END)::DOUBLE AS xor_ratio, 1.0::DOUBLE AS and_ratio FROM c""")
def j22_a12_description_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text in four has a task and an actor that are alike, not equal."""
    both = spark.sql(f"SELECT o_orderkey AS doc_id, {_GOLD_TEXT} AS gold, {_FOUND_TEXT} AS found FROM parquet.`{sf_dir}/orders.parquet`")
    rows = description_evaluation.evaluate(both.select("doc_id", F.col("found").alias("text")), both.select("doc_id", F.col("gold").alias("text")), ["doc_id"])
    counts = [F.col(c).cast("int").alias(c) for c in ("gold_actor_count", "pred_actor_count", "gold_task_count", "pred_task_count", "matched_tasks", "gold_total_sentences", "pred_total_sentences", "gold_total_tokens", "pred_total_tokens")]
    means = ["gold_avg_tokens_per_sentence", "pred_avg_tokens_per_sentence", "pred_tokens_per_sentence"]
    return rows.select("doc_id", *counts, "actor_precision", "actor_recall", "task_precision", "task_recall", "deontic_precision", "deontic_recall", "avg_task_similarity", *means, "xor_ratio", "and_ratio")


# --- sentences ------------------------------------------------------------------------------------------------------
def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT o_orderkey AS doc_id, {_SAYS} AS text FROM parquet.`{sf_dir}/orders.parquet`")


@query(f"SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 6 THEN 0 ELSE length('The ' || {_ACTOR} || ' ') + 1 END AS at, CASE WHEN o_orderkey % 7 <> 6 AND o_custkey % 5 = 1 THEN 'Commission' END AS actor FROM orders")
def n4_n5_explicit_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("doc_id", rewriting.first_modal(F.col("text")).alias("at"), rewriting.explicit_actor(F.col("text")).alias("actor"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'The Commission shall report.' WHEN o_orderkey % 4 = 2 THEN 'The Commission shall act pursuant to Article 2.' ELSE 'The Commission shall act.' END AS text FROM orders""")
def f6_f7_external_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth text is left with dangling words, which go."""
    text = F.concat(F.lit("The Commission shall act pursuant to Article "), F.col("o_orderkey") % 4, F.lit(" and Directive 95/46/EC."))
    text = F.when(F.col("o_orderkey") % 5 == 0, "The Commission shall report to Directive (EU) 95/46 and under Article 9.").otherwise(text)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), rules.drop_dangling(rewriting.external_reference_phrases(text, F.array(F.lit("2")))).alias("text"))


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'The file shall be kept by Commission.' WHEN 1 THEN 'The file shall be kept by the Board.' ELSE 'Commission shall keep it.' END AS passive,
    CASE WHEN o_orderkey % 2 = 0 THEN 'If asked, Council may object.' ELSE 'Council may object.' END AS pronoun FROM orders""")
def n8_n9_pronoun_and_passive(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    passive = F.when(key % 3 == 0, "The file shall be kept.").when(key % 3 == 1, "The file shall be kept by the Board.").otherwise("Commission shall keep it.")
    pronoun = F.when(key % 2 == 0, "If asked, it may object.").otherwise("They may object.")
    who = F.lit("Commission")
    return read(spark, sf_dir, "orders").select(key.alias("doc_id"), rewriting.name_agent(passive, who).alias("passive"), rewriting.resolve_pronoun(pronoun, F.lit(None).cast("string"), F.lit("Council")).alias("pronoun"))


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'The Board shall file the report.' WHEN 1 THEN 'The Board, which shall meet, must act.' ELSE 'The Board shall act.' END AS text FROM orders""")
def f8_n3_relative_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, "The Board shall file the report that was made in time.").when(key % 3 == 1, "The Board, which shall meet, must act.").otherwise("The Board shall act as defined in the annexed list.")
    return read(spark, sf_dir, "orders").select(key.alias("doc_id"), rules.normalize_spaces(rewriting.drop_relative_clauses(text)).alias("text"))


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 1 THEN 'Regulation (EU) No 12/2020' WHEN 2 THEN 'paragraph 3' WHEN 3 THEN 'Article 5;Article 8' WHEN 0 THEN 'Article 2' ELSE '' END AS refs FROM orders")
def f12_j13_sentence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir).withColumn("own", F.array(F.lit("2"), F.lit("6")))
    found = references.reference_rows(rows, ["doc_id"], "text", "own").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("reference")), ";").alias("refs"))
    return rows.select("doc_id").join(found, "doc_id", "left").na.fill("", ["refs"])


# what the rules make of the two sentences of a made-up regulation
_OBLIGED = "o_orderkey % 7 <> 6"
_SHORT = f"replace(replace(replace({_SAYS}, ', without undue delay,', ''), ' in particular', ''), 'in accordance with', 'IAW')"
_IF = f"concat('IF the ', {_OTHER}, ' objects, the ', {_ACTOR}, ' may refer to Annex IV.')"
_ITEM = f"""CASE WHEN {_OBLIGED} THEN concat({_SHORT}, ' the ', {_ACTOR}, ' shall include the ') WHEN o_custkey % 5 = 1 THEN concat(replace({_SHORT}, 'was seen to', 'was seen by Commission to'), ' Commission shall include the ')
    ELSE concat(replace({_SHORT}, 'was seen to', 'was seen by corresponding authority to'), ' It shall include the ') END"""
_CLAUSE_SQL = f"""SELECT o_orderkey AS doc_id, CASE o_orderkey % 5
    WHEN 0 THEN concat('Article 1: Scope', chr(10), CASE WHEN {_OBLIGED} THEN concat('1 ', {_SHORT}, chr(10)) ELSE '' END, '2 ', {_IF}, chr(10), '---', chr(10), 'Article 2: Reports', chr(10), '--PARALLEL TASKS--', chr(10), '1(a) ', {_ITEM}, 'date', chr(10), '1(b) ', {_ITEM}, 'place', chr(10), '--END OF PARALLEL TASKS--')
    WHEN 1 THEN concat('Art. 3: ', {_SAYS}, chr(10), '---', chr(10), 'Art. 4: ', {_WHERE})
    WHEN 2 THEN concat('1 Scope', CASE WHEN {_OBLIGED} THEN concat(chr(10), '1 ', {_SHORT}) ELSE '' END, chr(10), '2 Purpose of reports', chr(10), '2 ', {_IF}, chr(10), '3 Tasks', CASE WHEN {_OBLIGED} THEN concat(chr(10), '3 ', {_SHORT}) ELSE '' END)
    WHEN 3 THEN concat(CASE WHEN {_OBLIGED} THEN concat('1 ', {_SHORT}, chr(10)) ELSE '' END, '2 ', {_IF}, CASE WHEN {_OBLIGED} THEN concat(chr(10), '3 ', {_SHORT}) ELSE '' END)
    ELSE concat(CASE WHEN {_OBLIGED} THEN concat({_SHORT}, chr(10)) ELSE '' END, {_IF}) END AS text FROM orders"""


@query(_CLAUSE_SQL)
def b1_b6_clause_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.clause_text(regulations(spark, sf_dir))


@query("""WITH p AS (SELECT o_orderkey, unnest(CASE o_orderkey % 5 WHEN 0 THEN ['Article 1.1', 'Article 2.1 (1(a))', 'Article 2.1 (1(b))'] WHEN 2 THEN ['1', '3'] WHEN 3 THEN ['Article UNKNOWN.1', 'Article UNKNOWN.3'] ELSE [] END) AS location FROM orders)
    SELECT o_orderkey AS doc_id, location, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['Article 2'] WHEN 1 THEN ['Regulation (EU) No 12/2020'] WHEN 2 THEN ['paragraph 3'] WHEN 3 THEN ['Article 5', 'Article 6', 'Article 8'] ELSE [] END) AS reference FROM p""")
def d5_reference_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.reference_table(regulations(spark, sf_dir))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(^|\\n)Art(icle|\\.) [0-9]+:')) AS n_articles, 2 AS n_references, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words
    FROM (SELECT doc_id, 'Article ' || doc_id || ': x' || chr(10) || coalesce(text, '') AS text FROM documents)""")
def k12_job_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Article "), "doc_id", F.lit(": x\n"), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", *assembly.job_statistics(text, F.lit("Location,Reference\na,b\nc,d\n")))


# --- candidates -----------------------------------------------------------------------------------------------------
@query(f"""SELECT DISTINCT o_orderkey AS doc_id, unnest(CASE WHEN o_custkey % 5 = 1 AND o_custkey % 3 = 0 THEN ['Commission', 'Member State'] WHEN o_custkey % 5 = 1 THEN ['Commission'] WHEN o_custkey % 3 = 0 THEN ['Member State'] ELSE [] END) AS name, 'UNIT' AS actor_type FROM orders""")
def n14_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.institutions(_sentences(spark, sf_dir))


@query(f"""WITH a AS (SELECT o_orderkey AS doc_id, {_ACTOR} AS actor, {_OTHER} AS other, o_orderkey % 7 <> 6 AS obliged FROM orders)
    SELECT doc_id, actor AS name, 'ROLE' AS actor_type FROM a WHERE obliged AND actor NOT IN ('data controller', 'importer') UNION SELECT doc_id, actor, 'UNIT' FROM a WHERE actor NOT IN ('data controller', 'importer')
    UNION SELECT doc_id, other, 'UNIT' FROM a WHERE other <> 'operator'""")
def n11_n15_actor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who notifies is a role, who refers, objects or was seen a unit by its suffix; blacklisted and vague names are none, nor is a pronoun."""
    return candidates.actor_candidates(regulations(spark, sf_dir))


@query(f"""SELECT o_orderkey AS doc_id, regexp_extract({_SAYS}, '(?:shall|must|may|should)(?: not)? ([^,;.]*)', 1) AS label, {_MODAL} AS deontic_modality,
    CASE o_orderkey % 7 WHEN 0 THEN 'obligation' WHEN 1 THEN 'obligation' WHEN 2 THEN 'permission' WHEN 4 THEN 'recommendation' ELSE 'prohibition' END AS deontic_type,
    CASE o_orderkey % 6 WHEN 0 THEN '2' ELSE 'UNKNOWN' END AS source_article, 'UNKNOWN' AS source_paragraph FROM orders WHERE o_orderkey % 7 <> 6""")
def n17_n24_task_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.task_candidates(_sentences(spark, sf_dir)).select("doc_id", "label", "deontic_modality", "deontic_type", "source_article", "source_paragraph")


# --- answers, testsets ----------------------------------------------------------------------------------------------
@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'answer ' || o_orderpriority END AS said, CASE WHEN o_orderkey % 2 = 0 THEN 'answer ' || o_orderpriority ELSE 'none' END AS checked FROM orders")
def l1_l3_replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey") % 2).alias("text"), F.lit("none").alias("before"))
    prompt = completion.sectioned("Name the actors.", ("INPUT TEXT", F.col("text")))
    known = rows.where("doc_id % 2 = 0").select(F.col("text"), F.regexp_extract("text", r"^(.*) \d$", 1).alias("p")).distinct()
    table = known.select(F.explode(F.array(F.lit("actors"), F.lit("actors_validated"))).alias("stage"), completion.prompt_hash(prompt).alias("prompt_hash"), F.concat(F.lit("answer "), "p").alias("_a"))
    table = table.select("stage", "prompt_hash", F.when(F.col("stage") == "actors", F.col("_a")).otherwise(F.concat(F.lit("so: <FINAL_LIST>"), "_a", F.lit("</FINAL_LIST>"))).alias("response"))
    replay = completion.Replay(table)
    asked = completion.ask(rows, replay, "actors", prompt, "said")
    return completion.validated(asked, replay, "actors_validated", prompt, "before", "checked").select("doc_id", "said", "checked")


@query("""SELECT o_orderkey AS doc_id, '---CANDIDATE---' || chr(10) || 'label: Clerk ' || o_custkey || chr(10) || 'deontic_type: obligation' || chr(10) || 'deontic_modality: shall' || chr(10) || 'conditions: ' || CASE WHEN o_orderkey % 2 = 0 THEN '(none)' ELSE 'if a ;; if b' END || chr(10) || 'article: 3' || chr(10) || 'paragraph: UNKNOWN' || chr(10) || '---END---' AS block FROM orders""")
def l10_candidate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "concat('Clerk ', o_custkey) AS label", "'obligation' AS deontic_type", "'shall' AS deontic_modality", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(array() AS array<string>) ELSE array('if a', 'if b') END AS conditions", "'3' AS source_article", "'UNKNOWN' AS source_paragraph")
    return rows.select("doc_id", completion.candidate_block().alias("block"))


@query("""SELECT o_orderkey AS doc_id, 'Clerk ' || o_custkey AS child, 'Board' AS parent, 'ROLE-UNIT' AS relation FROM orders WHERE o_orderkey % 3 = 1
    UNION ALL SELECT o_orderkey, 'Board', 'Agency', 'UNIT' FROM orders WHERE o_orderkey % 3 = 1""")
def g14_relation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Clerk "), "o_custkey", F.lit(" | Board | role unit\nshort | line\nBoard | Agency | unit\nBoard | Agency | OTHER"))).when(F.col("o_orderkey") % 3 == 2, "no_hierarchies\na | b | ROLE-UNIT").otherwise("nothing")
    return parsing.relation_lines(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), line.alias("response"))).drop("line_no")


@query("""SELECT o_orderkey AS doc_id, 0 AS task_no, 'Management Board' AS unit, 'Member' AS role FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 0, 'Board', 'Clerk ' || o_custkey FROM orders WHERE o_orderkey % 2 = 1
    UNION ALL SELECT o_orderkey, 1, 'Sales', 'Clerk ' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 2, 'Desk', 'Clerk ' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 2, 'Board', 'Clerk ' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 3, 'Nobody', 'Nobody' FROM orders""")
def e6_j9_performers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a document with two or three subjects; open texts go to the first name of the chart that holds them or
    that they hold."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Clerk "), "o_custkey").alias("clerk"))
    subject = lambda n, unit, role: F.struct(F.lit(n).alias("subject_no"), F.lit(unit).alias("unit"), role.alias("role"))
    clerks = [subject(1, "Desk", F.col("clerk")), subject(2, "Board", F.col("clerk"))]
    chart = F.when(F.col("doc_id") % 2 == 0, F.array(subject(0, "Management Board", F.lit("Member")), *clerks)).otherwise(F.array(*clerks))
    known = o.select("doc_id", F.explode(chart).alias("s")).select("doc_id", "s.*")
    text = F.array(F.lit("board"), F.concat(F.lit("unit: Sales, role: "), "clerk"), F.concat(F.lit("the "), "clerk", F.lit(" of it")), F.lit("Nobody"))
    tasks = o.select("doc_id", F.posexplode(text).alias("task_no", "said")).select("doc_id", "task_no", parsing.performers(F.col("said")).alias("performers"))
    return entities.task_performers(tasks, known).select("doc_id", "task_no", "unit", "role")


@query("SELECT o_orderkey AS job_id, 'https-post://example.org/worklist/' || o_orderkey || '/' AS url, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6) AS BIGINT) AS instance FROM orders")
def f22_f27_end_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("worklist/"), "o_orderkey", F.lit("/"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), testset.endpoint(F.lit("example.org"), path, "post").alias("url"), testset.instance_number(F.col("o_orderkey").cast("string")).alias("instance"))


# --- reports --------------------------------------------------------------------------------------------------------
def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.concat(F.col("l_suppkey") % 12 + 1, F.lit("_doc.xml")).alias("file"), F.concat(F.lit("raw/run_"), "l_linenumber").alias("run_label"), F.trim("l_returnflag").alias("section")).agg(F.round(F.avg(F.col("l_quantity").cast("double")), 4).alias("f1"))


_METRIC_SQL = "SELECT (l_suppkey % 12 + 1)::VARCHAR || '_doc.xml' AS file, 'raw/run_' || l_linenumber AS run_label, trim(l_returnflag) AS section, round(avg(l_quantity::DOUBLE), 4) AS f1 FROM lineitem GROUP BY ALL"


@query(f"""WITH m AS (SELECT split_part(file, '_', 1)::INT AS d, f1 FROM ({_METRIC_SQL}) WHERE run_label IN ('raw/run_1', 'raw/run_2', 'raw/run_3')), p AS (SELECT d, avg(f1) AS f1 FROM m GROUP BY d)
    SELECT dense_rank() OVER (ORDER BY d)::INT AS doc_index, round(f1, 6) AS f1 FROM p UNION ALL SELECT NULL, round(avg(f1), 6) FROM p""")
def r1_r3_averaged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.averaged(_metric_rows(spark, sf_dir), ["f1"]).withColumn("f1", F.round("f1", 6))


@query(f"""SELECT 0 AS level, section, run_label, file, f1 FROM ({_METRIC_SQL}) UNION ALL SELECT 1, section, 'SECTION_AVG', 'SECTION_MACRO_AVG', round(avg(f1), 4) FROM ({_METRIC_SQL}) GROUP BY section
    UNION ALL SELECT 2, 'ALL', 'OVERALL_AVG', 'SECTION_MACRO_AVG', round(avg(f1), 4) FROM ({_METRIC_SQL})""")
def k8_a9_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.metric_rows(_metric_rows(spark, sf_dir), ["f1"], overall=True)


_KINDS_SQL = "SELECT CASE WHEN l_linestatus = 'F' THEN 'raw' ELSE 'preprocessed' END AS kind, l_suppkey AS doc, l_linenumber AS run, round(avg(l_discount::DOUBLE), 6) AS recall, count(*)::INT AS matched, sum(l_quantity::DOUBLE)::INT AS gold FROM lineitem GROUP BY ALL"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "F", "raw").otherwise("preprocessed")
    return read(spark, sf_dir, "lineitem").groupBy(kind.alias("kind"), F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("run")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("recall"), F.count("*").cast("int").alias("matched"), F.sum(F.col("l_quantity").cast("double")).cast("int").alias("gold"))


@query(f"""WITH k AS ({_KINDS_SQL}), s AS (SELECT doc, run, max(recall) FILTER (kind = 'raw') AS raw, max(recall) FILTER (kind = 'preprocessed') AS prep FROM k GROUP BY ALL)
    SELECT *, coalesce(raw > prep, false) AS raw_bold, coalesce(prep > raw, false) AS prep_bold FROM s""")
def j31_f26_better_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.better_of_two(_kinds(spark, sf_dir), "recall")


@query(f"""WITH k AS ({_KINDS_SQL}), p AS (SELECT kind, doc, avg(recall) AS r, round_even(avg(matched), 0)::INT AS m, round_even(avg(gold), 0)::INT AS g FROM k GROUP BY ALL)
    SELECT kind, round(sum(r) / (SELECT count(DISTINCT doc) FROM k), 6) AS recall, sum(m)::BIGINT AS matched, sum(g)::BIGINT AS gold FROM p GROUP BY kind""")
def r4_a22_a23_completeness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.completeness_summary(_kinds(spark, sf_dir), "recall", "matched", "gold").withColumn("recall", F.round("recall", 6))
