"""Registered queries over scans, sinks and entities of charts, task tables and control-flow blocks, and over reports.

The XML that the scans read is put together from all rows of the driver's tables by SQL; the oracles say what the rows
must be from the same tables, with expressions of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query, read
from .functions import rewriting
from .operators import assign, candidates, completion, entities, parsing, process_graph, testset
from .plans import process_evaluation, reports
from .sources import documents, sinks


def made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SQL text over the driver's tables, named in braces."""
    return spark.sql(text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("orders", "customer", "lineitem", "supplier", "part", "nation")}))


# --- charts: a nation is a chart, its customers' segments units, account classes roles -----------------------------------
_CHARTS = """SELECT c_nationkey AS model_id, concat('<?xml version="1.0"?>', chr(10), '<o:organisation xmlns:o="http://cpee.org/ns/organisation/1.0"><o:units>', array_join(array_sort(collect_list(concat('<o:unit id=" U', lpad(c_custkey, 9, '0'), '">', CASE WHEN c_custkey % 3 = 0 THEN concat('<o:parent> ', trim(c_mktsegment), ' </o:parent><o:parent>Board</o:parent>') ELSE '' END, '</o:unit>'))), ''), '<o:unit id=" "/></o:units><o:roles>',
    array_join(array_sort(collect_list(concat('<o:role id="R', lpad(c_custkey, 9, '0'), '"', CASE WHEN c_custkey % 2 = 0 THEN '><o:parent>Chief</o:parent></o:role>' ELSE '/>' END))), ''), '<o:role id="Chief"/></o:roles><o:subjects>',
    array_join(array_sort(collect_list(concat('<o:subject id="S', lpad(c_custkey, 9, '0'), '" uid="u"><o:relation unit="', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('U', lpad(c_custkey, 9, '0')) END, '" role="R', lpad(c_custkey, 9, '0'), '"/><o:relation unit="Board" role="Chief"/></o:subject>'))), ''), '</o:subjects></o:organisation>') AS xml
    FROM {customer} GROUP BY c_nationkey"""
_U, _R, _S = ("'%s' || lpad(c_custkey::VARCHAR, 9, '0')" % x for x in "URS")


def _charts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return documents.organigrams(made(spark, sf_dir, _CHARTS))


def _parts(chart: dict[str, DataFrame]) -> DataFrame:
    """model_id, part, a, b, c of all rows of a chart."""
    named = lambda part: chart[part].select("model_id", F.lit(part).alias("part"), F.col("name").alias("a"), F.col("parent").alias("b"), F.lit(None).cast("string").alias("c"))
    return named("units").unionByName(named("roles")).unionByName(chart["bindings"].select("model_id", F.lit("bindings").alias("part"), F.col("subject").alias("a"), F.col("unit").alias("b"), F.col("role").alias("c")))


_PARTS_SQL = f"""SELECT c_nationkey AS model_id, 'units' AS part, {_U} AS a, CASE WHEN c_custkey % 3 = 0 THEN trim(c_mktsegment) END AS b, NULL::VARCHAR AS c FROM customer UNION ALL SELECT c_nationkey, 'units', {_U}, 'Board', NULL FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_nationkey, 'roles', {_R}, CASE WHEN c_custkey % 2 = 0 THEN 'Chief' END, NULL FROM customer UNION ALL SELECT DISTINCT c_nationkey, 'roles', 'Chief', NULL, NULL FROM customer"""


@query(f"""{_PARTS_SQL} UNION ALL SELECT c_nationkey, 'bindings', {_S}, {_U}, {_R} FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_nationkey, 'bindings', {_S}, 'Board', 'Chief' FROM customer""")
def s3_chart_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank ids and relations without a unit go, all parents and relations stay."""
    return _parts(_charts(spark, sf_dir))


@query(f"SELECT c_nationkey AS model_id, 'unit: ' || {_U} || ', role: ' || {_R} AS line FROM customer WHERE c_custkey % 5 <> 0")
def s9_subject_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first relation of each subject, if it has a unit and a role."""
    return documents.first_relations(_charts(spark, sf_dir)["bindings"]).select("model_id", completion.subject_line().alias("line"))


@query(f"""SELECT c_nationkey AS model_id, 'Chief' AS source, {_R} AS target, 'role' AS kind FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_nationkey, {_U}, {_R}, 'binding' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 5 <> 0""")
def e5_j8_s4_chart_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By each element's first parent; no unit of these charts has a parent that is one, nor is Board a unit."""
    chart = _charts(spark, sf_dir)
    return entities.hierarchy_edges(documents.first_parents(chart["units"]), documents.first_parents(chart["roles"]), chart["bindings"])


@query(f"""{_PARTS_SQL} UNION ALL SELECT c_nationkey, 'bindings', {_S}, {_U}, {_R} FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_nationkey, 'bindings', {_S}, 'Board', 'Chief' FROM customer""")
def k2_chart_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts written as XML and read again."""
    chart = _charts(spark, sf_dir)
    return _parts(documents.organigrams(documents.organigram_xml(chart["units"], chart["roles"], chart["bindings"])))


# --- entities that a model names: an order is a document -------------------------------------------------------------
_ACTORS = """SELECT o_orderkey AS doc_id, concat('Board | UNIT', chr(10), 'Clerk-', o_custkey, ' of it | ROLE', chr(10), 'Chief | BOTH', chr(10), 'Board | ROLE') AS said,
    concat('Clerk-', o_custkey, ' of it | Chief | ROLE', chr(10), CASE o_orderkey % 3 WHEN 0 THEN concat('Clerk-', o_custkey, ' of it | Desk | role-unit', chr(10)) WHEN 1 THEN concat('Clerk-', o_custkey, ' of it | Board | ROLE UNIT', chr(10)) ELSE '' END, 'Board | Agency | UNIT', chr(10), 'Chief | Board | UNIT') AS relations FROM {orders}"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, _ACTORS)
    return entities.build_entities(parsing.actor_lines(rows.select("doc_id", F.col("said").alias("response"))), parsing.relation_lines(rows.select("doc_id", F.col("relations").alias("response"))))


_CLERK = "'Clerk-' || o_custkey || ' of it'"


@query(f"""SELECT o_orderkey AS doc_id, 0 AS ord, 'Board | Agency | UNIT' AS line FROM orders UNION ALL SELECT o_orderkey, 1, {_CLERK} || ' | Chief | ROLE' FROM orders
    UNION ALL SELECT o_orderkey, 2, {_CLERK} || CASE o_orderkey % 3 WHEN 0 THEN ' | Desk | ROLE-UNIT' ELSE ' | Board | ROLE-UNIT' END FROM orders WHERE o_orderkey % 3 < 2""")
def e1_e4_relation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role keeps only relations between roles and to units, a unit those between units."""
    return entities.relation_text(_entities(spark, sf_dir))


@query(f"""SELECT o_orderkey AS doc_id, 'Board' AS name, 'unit' AS entity_type, '' AS units FROM orders UNION ALL SELECT o_orderkey, 'Board', 'role', '' FROM orders UNION ALL SELECT o_orderkey, 'Chief', 'role', 'External' FROM orders
    UNION ALL SELECT o_orderkey, {_CLERK}, 'role', CASE o_orderkey % 3 WHEN 0 THEN 'Desk' WHEN 1 THEN 'Board' ELSE 'External' END FROM orders UNION ALL SELECT o_orderkey, 'Desk', 'unit', '' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'External', 'unit', '' FROM orders""")
def e2_j7_fallback_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.with_fallback_units(_entities(spark, sf_dir))
    return rows.select("doc_id", "name", "entity_type", F.array_join("unit_parents", ";").alias("units"))


@query(f"""SELECT o_orderkey AS doc_id, {_CLERK} AS role, CASE o_orderkey % 3 WHEN 0 THEN 'Desk' WHEN 1 THEN 'Board' ELSE 'External' END AS unit, 'clerk_name it_surname' AS name, 'cl' || substr(o_custkey::VARCHAR, 1, 2) || 's' AS uid FROM orders
    UNION ALL SELECT o_orderkey, 'Chief', 'External', 'chief_name chief_surname', 'chs' FROM orders UNION ALL SELECT o_orderkey, 'Board', 'Board', 'board_name board_surname', 'bos' FROM orders""")
def a26_e3_f21_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.subjects(entities.with_fallback_units(_entities(spark, sf_dir))).select("doc_id", "role", "unit", "name", "uid")


@query("""SELECT l_orderkey AS doc_id, 1 AS n, 'roun' || CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) = 1 THEN 's' ELSE row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey)::VARCHAR END AS uid FROM lineitem""")
def w7_running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many roles of one document whose names begin alike."""
    rows = process_graph.numbered(read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), ["doc_id"], ["l_linenumber", "l_suppkey", "l_partkey"], "ord")
    none = F.array().cast("array<string>")
    roles = rows.select("doc_id", "ord", F.concat(F.lit("Role/under "), "l_linenumber").alias("name"), F.lit("role").alias("entity_type"), none.alias("parents"), none.alias("unit_parents"))
    return entities.subjects(roles).select("doc_id", "uid", F.lit(1).alias("n"))


# --- task tables: a customer is a table, an order a task ---------------------------------------------------------------
_TABLES = """SELECT o_custkey AS model_id, concat('<?xml version="1.0"?><tasks>', array_join(transform(array_sort(collect_list(struct(o_orderkey, concat('<task id="t', o_orderkey, '"><label>', CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE concat(' File ', o_orderkey, ' ') END, '</label><performers>',
    CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '<performer><unit>Desk</unit><role> Clerk </role></performer><performer><role>Clerk</role></performer><performer/>' WHEN 2 THEN '<performer><unit>Board</unit></performer>' ELSE '<performer><unit> </unit><role>Chief</role></performer><performer><unit>Desk</unit><role>Aide</role></performer>' END, '</performers>',
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('<deontic type="', CASE o_orderkey % 5 WHEN 1 THEN 'Obligation' WHEN 2 THEN 'PERMISSION' WHEN 3 THEN 'prohibition' ELSE 'wish' END, '" modality="Shall"/>') END, '<conditions><condition> if ', o_orderkey, '</condition><condition> </condition></conditions><exceptions>',
    CASE o_orderkey % 3 WHEN 0 THEN '<exception description="unless paid" ref="t1"/>' WHEN 1 THEN '<exception>by word</exception>' ELSE '' END, '</exceptions>', CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('<source-ref article="', o_orderkey % 9, '" paragraph="2"/>') END, '</task>') AS x))), s -> s.x), ''), '</tasks>') AS xml
    FROM {orders} GROUP BY o_custkey"""
_ROLES_SQL = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Clerk' WHEN 2 THEN '' ELSE 'Chief;Aide' END"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, _TABLES)


def _flat_tasks(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit("-"))
    people = F.transform("performers", lambda p: F.concat(blank(F.nullif(F.trim(p["unit"]), F.lit(""))), F.lit("/"), blank(F.nullif(F.trim(p["role"]), F.lit("")))))
    return rows.select("model_id", "task_id", "label", F.array_join(people, ";").alias("performers"), "deontic_type", "deontic_modality", F.array_join("conditions", ";").alias("conditions"), F.array_join(documents.exception_texts(F.col("exceptions")), ";").alias("exceptions"), "source_article", "source_paragraph")


_TASKS_SQL = """SELECT o_custkey AS model_id, 't' || o_orderkey AS task_id, 'File ' || o_orderkey AS label, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Desk/Clerk;-/Clerk' WHEN 2 THEN 'Board/-' ELSE '-/Chief;Desk/Aide' END AS performers,
    CASE o_orderkey % 5 WHEN 1 THEN 'obligation' WHEN 2 THEN 'permission' WHEN 3 THEN 'prohibition' WHEN 4 THEN 'wish' END AS deontic_type, CASE WHEN o_orderkey % 5 <> 0 THEN 'shall' END AS deontic_modality, 'if ' || o_orderkey AS conditions,
    CASE o_orderkey % 3 WHEN 0 THEN 'unless paid' WHEN 1 THEN 'by word' ELSE '' END AS exceptions, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 9)::VARCHAR END AS source_article, CASE WHEN o_orderkey % 6 <> 0 THEN '2' END AS source_paragraph FROM orders WHERE o_orderkey % 7 <> 0"""


@query(_TASKS_SQL)
def s5_task_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_tasks(documents.tasks(_tables(spark, sf_dir)))


@query(f"""SELECT o_custkey AS model_id, 't' || o_orderkey AS task_id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'File ' || o_orderkey END AS label, {_ROLES_SQL} AS actors, CASE WHEN o_orderkey % 5 = 0 THEN 'shall' ELSE 'Shall' END AS deontic_modality, CASE o_orderkey % 3 WHEN 0 THEN 'unless paid' ELSE '' END AS exceptions,
    CASE WHEN o_orderkey % 6 = 0 THEN 'UNKNOWN' ELSE (o_orderkey % 9)::VARCHAR END AS source_article FROM orders""")
def s6_f31_described_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.described_tasks(_tables(spark, sf_dir))
    return rows.select("model_id", "task_id", "label", F.array_join("actors", ";").alias("actors"), "deontic_modality", F.array_join("exceptions", ";").alias("exceptions"), "source_article")


@query("""SELECT o_custkey AS model_id, 't' || o_orderkey AS task_id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Clerk;Clerk' WHEN 2 THEN 'Board' ELSE 'Chief;Aide' END AS actors, CASE o_orderkey % 5 WHEN 1 THEN 'deontic-obligation' WHEN 2 THEN 'deontic-permission' WHEN 3 THEN 'deontic-prohibition' ELSE '' END AS deontic_css,
    CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'shall' WHEN 2 THEN 'may' WHEN 3 THEN 'shall not' ELSE 'Shall' END AS deontic_badge, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'Art. ' || o_orderkey % 9 || ' §2' END AS source FROM orders""")
def s7_f24_task_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.task_cards(_tables(spark, sf_dir)).select("model_id", "task_id", F.array_join("actors", ";").alias("actors"), "deontic_css", "deontic_badge", "source")


@query("""SELECT o_custkey AS model_id, 't' || o_orderkey AS task_id, CASE o_orderkey % 4 WHEN 1 THEN 'Clerk' WHEN 3 THEN 'Chief' ELSE '' END AS role, CASE o_orderkey % 4 WHEN 1 THEN 'Desk' WHEN 2 THEN 'Board' ELSE '*' END AS unit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS task_no FROM orders""")
def s8_w5_first_performers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.first_performers(_tables(spark, sf_dir)).select("model_id", "task_id", "role", "unit", F.col("task_no").cast("long").alias("task_no"))


@query(_TASKS_SQL.replace("CASE WHEN o_orderkey % 5 <> 0 THEN 'shall' END", "CASE WHEN o_orderkey % 5 <> 0 THEN 'shall' ELSE '' END").replace("WHEN 4 THEN 'wish' END", "WHEN 4 THEN 'wish' ELSE '' END").replace("CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 9)::VARCHAR END", "CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 9)::VARCHAR ELSE '' END").replace("CASE WHEN o_orderkey % 6 <> 0 THEN '2' END", "CASE WHEN o_orderkey % 6 <> 0 THEN '2' ELSE '' END"))
def k4_task_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task tables written as XML and read again; what a task doesn't say is written empty."""
    rows = documents.tasks(_tables(spark, sf_dir))
    said = F.transform(documents.exception_texts(F.col("exceptions")), lambda e: F.struct(e.alias("description"), F.lit("").alias("ref")))
    again = documents.tasks(sinks.task_xml(rows.withColumn("exceptions", said)))
    return _flat_tasks(again.na.fill("", ["deontic_type", "deontic_modality", "source_article", "source_paragraph"]))


@query("""SELECT o_custkey AS model_id, 't' || o_orderkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 6 = 0 THEN 999 ELSE o_orderkey % 9 END, CASE WHEN o_orderkey % 6 = 0 THEN 999 ELSE 2 END, o_orderkey) AS n,
    '[t' || o_orderkey || '] ' || CASE o_orderkey % 4 WHEN 1 THEN 'Clerk' WHEN 3 THEN 'Chief or Aide' ELSE 'Unknown Actor' END || CASE WHEN o_orderkey % 5 = 0 THEN ' shall ' ELSE ' Shall ' END || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'File ' || o_orderkey END || chr(10) || '  CONDITION: if ' || o_orderkey || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '  EXCEPTION: unless paid' || chr(10) ELSE '' END
    || CASE WHEN o_orderkey % 6 = 0 THEN '  SOURCE: Article UNKNOWN, §UNKNOWN' ELSE '  SOURCE: Article ' || o_orderkey % 9 || ', §2' END AS text FROM orders""")
def o2_f23_task_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = documents.described_tasks(_tables(spark, sf_dir))
    n = F.row_number().over(Window.partitionBy("model_id").orderBy(*completion.task_order()))
    return rows.select("model_id", "task_id", n.cast("long").alias("n"), completion.task_sentence().alias("text"))


# --- control-flow blocks: an order is a block, its lines calls -----------------------------------------------------------
_BLOCKS = """SELECT l_orderkey AS job_id, concat('<x:description xmlns:x="http://cpee.org/ns/description/1.0" xmlns:a="http://cpee.org/ns/annotation/1.0">', CASE WHEN l_orderkey % 2 = 0 THEN '<x:parallel a:note="1">' ELSE '' END, array_join(transform(array_sort(collect_list(struct(l_linenumber, l_suppkey, l_partkey,
    concat('<x:call id="c', l_linenumber, '" endpoint="user"><x:parameters><x:label>Part ', l_partkey, '</x:label></x:parameters>', CASE WHEN l_linenumber % 3 = 0 THEN concat('<x:code><x:role>R', l_suppkey, '</x:role></x:code>') ELSE '' END, '</x:call>') AS x))), s -> s.x), ''), CASE WHEN l_orderkey % 2 = 0 THEN '</x:parallel>' ELSE '' END, '</x:description>') AS xml,
    concat('org ', l_orderkey) AS orgmodel, 'form & more' AS form FROM {lineitem} GROUP BY l_orderkey"""
_LINE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1"
_CALLS_SQL = f"SELECT l_orderkey AS job_id, ({_LINE})::INTEGER AS ord, 'c' || l_linenumber AS call_id, 'Part ' || l_partkey AS label, CASE WHEN l_linenumber % 3 = 0 THEN 'R' || l_suppkey ELSE '' END AS role, l_suppkey, l_linenumber FROM lineitem"


@query(f"SELECT job_id, ord, call_id, label, role, CASE WHEN job_id % 2 = 0 THEN 'description/parallel' ELSE 'description' END AS path FROM ({_CALLS_SQL})")
def e8_s15_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testset.calls(made(spark, sf_dir, _BLOCKS)).withColumn("path", F.array_join("path", "/"))


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = testset.calls(made(spark, sf_dir, _BLOCKS))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("task_no"), F.concat(F.lit("Part "), "l_partkey").alias("label"), F.concat(F.lit("M"), "l_partkey").alias("role"), F.concat(F.lit("unit of "), "l_partkey").alias("unit"))
    return testset.assign_roles(found, lines, found)


# a role that a call of the same id states goes first (the last of several), then one of the same label, then that of the equal, so most alike, label
_ASSIGNED_SQL = f"""WITH c AS ({_CALLS_SQL}), i AS (SELECT job_id, call_id, max_by(role, ord) AS r FROM c WHERE role <> '' GROUP BY ALL), l AS (SELECT job_id, label, max_by(role, ord) AS r FROM c WHERE role <> '' GROUP BY ALL),
    a AS (SELECT c.job_id, c.ord, c.call_id, c.label, coalesce(i.r, l.r, 'M' || substr(c.label, 6)) AS role, 'unit of ' || substr(c.label, 6) AS unit FROM c LEFT JOIN i ON i.job_id = c.job_id AND i.call_id = c.call_id LEFT JOIN l ON l.job_id = c.job_id AND l.label = c.label)"""


@query(_ASSIGNED_SQL + " SELECT * FROM a")
def j11_call_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir)


@query(_ASSIGNED_SQL + " SELECT job_id, ord, '' AS call_id, label, role, 'org ' || job_id AS orgmodel, 'form & more' AS form, 0 AS annotated FROM a")
def e9_enriched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt calls, read back from the XML that was written."""
    made_xml = testset.enriched(made(spark, sf_dir, _BLOCKS), _roles(spark, sf_dir))
    rows = testset.worklist_calls(made_xml.select("job_id", "xml", F.contains("xml", F.lit("annotation")).cast("int").alias("annotated")))
    return rows.select("job_id", "ord", F.lit("").alias("call_id"), "label", "role", "orgmodel", "form", "annotated")


@query(_ASSIGNED_SQL + """, f AS (SELECT job_id, call_id, label, role, min(ord) AS ord, min_by(unit, ord) AS unit FROM a GROUP BY ALL)
    SELECT job_id, '<?xml version="1.0"?>' || chr(10) || '<tasks>' || chr(10) || string_agg('  <task callback_id="ID" cpee_callback="https://example.org/N/callbacks/ID/" cpee_instance="N" cpee_base="https://example.org/" instance_uuid="U" cpee_label="' || label || '" cpee_activity="' || call_id || '" orgmodel="o&amp;m">' || chr(10) || '    <process>Worklist (N)</process>' || chr(10) || '    <label>' || label || '</label>' || chr(10) || '    <role>' || role || '</role>' || chr(10)
        || '    <unit>' || unit || '</unit>' || chr(10) || '    <user uid="test">Tester</user>' || chr(10) || '  </task>' || chr(10), '' ORDER BY ord) || '</tasks>' AS xml FROM f GROUP BY job_id""")
def k6_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the random ids and the instance number, which f22_f27_end_points checks."""
    rows = testset.worklist_xml(_roles(spark, sf_dir), F.lit("o&m"), "https://example.org/")
    xml = F.regexp_replace(F.regexp_replace(F.regexp_replace("xml", r'callback_id="[0-9a-f]{32}"', 'callback_id="ID"'), r"example.org/\d+/callbacks/[0-9a-f]{32}/", "example.org/N/callbacks/ID/"), r'(cpee_instance="|Worklist \()\d+', "$1N")
    xml = F.regexp_replace(xml, 'instance_uuid="[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"', 'instance_uuid="U"')
    return rows.select("job_id", xml.alias("xml"))


@query("""SELECT l_orderkey AS job_id, 'https://example.org/w/' || l_orderkey AS worklist, 'o&' || l_orderkey AS orgmodel, 'maker' AS creator, 6 AS n_endpoints, count(*) AS n_calls, true AS indented FROM lineitem GROUP BY l_orderkey""")
def k7_testset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole testset says, read back by paths."""
    blocks = made(spark, sf_dir, _BLOCKS)
    xml = testset.testset_xml(F.col("xml"), F.concat(F.lit("https://example.org/w/"), "job_id"), F.concat(F.lit("o&"), "job_id"), "maker")
    whole = blocks.select("job_id", xml.alias("whole"))
    rows = testset.testset_facts(whole.select("job_id", "whole", F.contains("whole", F.lit("\n    <x:description")).alias("indented")), "whole")
    return rows.select("job_id", "worklist", "orgmodel", "creator", (F.col("n_endpoints") - 1).cast("int").alias("n_endpoints"), "n_calls", "indented")


# --- candidates, tokens, prompts -----------------------------------------------------------------------------------------
_DELEGATIONS = "concat('--PARALLEL TASKS--', chr(10), '3. The Board shall ', CASE o_orderkey % 3 WHEN 0 THEN 'ensure that the clerk files form ' WHEN 1 THEN 'request the clerk to file form ' ELSE 'file form ' END, o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN ' and close the case' ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN ', if the clerk agrees' ELSE '' END, '.')"


@query("""WITH b AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'if the clerk agrees' ELSE '' END AS c FROM orders)
    SELECT doc_id, CASE k WHEN 0 THEN 'ensure that the clerk files form ' || doc_id WHEN 1 THEN 'request the clerk to file form ' || doc_id ELSE 'file form ' || doc_id END AS label, c AS conditions, 'obligation' AS deontic_type, 'shall' AS deontic_modality, '3' AS source_paragraph FROM b
    UNION ALL SELECT doc_id, 'close the case', c, 'obligation', 'shall', '3' FROM b WHERE k = 2
    UNION ALL SELECT doc_id, 'file form ' || doc_id, CASE WHEN c = '' THEN 'if requested' ELSE c || ';if requested' END, 'obligation', 'shall', '3' FROM b WHERE k = 1
    UNION ALL SELECT doc_id, 'files form ' || doc_id, c, 'obligation', 'shall', '3' FROM b WHERE k = 0""")
def n20_n22_p6_delegated_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delegating or requesting verb hands on is a task of its own, joined verbs are two; marker lines say nothing."""
    docs = made(spark, sf_dir, f"SELECT o_orderkey AS doc_id, {_DELEGATIONS} AS text FROM {{orders}}")
    return candidates.task_candidates(docs).select("doc_id", "label", F.array_join("conditions", ";").alias("conditions"), "deontic_type", "deontic_modality", "source_paragraph")


@query("""SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END, c_name, c_custkey) AS n, c_custkey FROM customer""")
def o3_candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "UNIT").otherwise("ROLE").alias("actor_type"))
    return rows.select("k", F.row_number().over(Window.partitionBy("k").orderBy(*candidates.candidate_order(), "c_custkey")).cast("long").alias("n"), "c_custkey")


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'the ' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'Board' WHEN o_orderkey % 5 = 0 THEN 'it also' ELSE 'it' END || ' shall' || CASE WHEN o_orderkey % 5 = 0 THEN ' also' ELSE '' END || ' act' AS text FROM orders""")
def b6_token_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal goes before replacement, replacement before insertion (token 1 has both); a token keeps the space after it."""
    rows = made(spark, sf_dir, """SELECT o_orderkey AS doc_id, array(named_struct('i', 0, 'text', 'the', 'ws', ' '), named_struct('i', 1, 'text', 'it', 'ws', ' '), named_struct('i', 2, 'text', 'shall', 'ws', ' '), named_struct('i', 3, 'text', 'act', 'ws', '')) AS t,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(array() AS array<int>) ELSE array(0) END AS r, CASE WHEN o_orderkey % 2 = 0 THEN map(0, 'the', 1, 'Board') ELSE map(0, 'the') END AS s, CASE WHEN o_orderkey % 5 = 0 THEN map(1, 'also', 2, 'also', 0, '') ELSE map(0, '') END AS n FROM {orders}""")
    return rows.select("doc_id", rewriting.apply_plan(*map(F.col, "trsn")).alias("text"))


@query("""SELECT o_orderkey AS doc_id, o_orderkey % 4 < 2 AS fell_back, CASE WHEN o_orderkey % 4 < 2 THEN 'Plain.' || chr(10) || chr(10) || 'INPUT TEXT:' || chr(10) || o_orderpriority ELSE 'With candidates.' || chr(10) || chr(10) || 'CANDIDATES:' || chr(10) || 'n ' || o_orderkey % 4 || chr(10) || chr(10) || 'INPUT TEXT:' || chr(10) || o_orderpriority || ' end' END AS prompt FROM orders""")
def l6_l10_hybrid_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too few candidates: the plain prompt."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("text"), (F.col("o_orderkey") % 4).alias("n"))
    listed = F.concat(F.lit("n "), "n")
    plain, rich = completion.sectioned("Plain.", ("INPUT TEXT", F.col("text"))), completion.sectioned("With candidates.", ("CANDIDATES", listed), ("INPUT TEXT", F.col("text")), ending=" end")
    return completion.hybrid(rows, F.col("n"), rich, plain).select("doc_id", "fell_back", "prompt")


# --- files and reports -------------------------------------------------------------------------------------------------
@query("""SELECT s_suppkey || '_doc.xml' AS file, 'raw' AS section, 'run_' || s_nationkey AS run, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey || '_text.txt' END AS source FROM supplier WHERE s_suppkey % 3 <> 0""")
def s14_j1_j2_paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted files of one name, and the source text that begins with the same number."""
    s = read(spark, sf_dir, "supplier")
    name = F.concat("s_suppkey", F.lit("_doc.xml"))
    gold = s.where("s_suppkey % 3 <> 0").select(name.alias("file"), F.concat(F.lit("/gold/"), name).alias("path"))
    found = s.select(name.alias("file"), F.concat(F.lit("/pred/raw/run_"), "s_nationkey", F.lit("/"), name).alias("path"))
    texts = s.where("s_suppkey % 2 = 0").select(F.explode(F.array(F.concat("s_suppkey", F.lit("_text.txt")), F.concat("s_suppkey", F.lit("_z.txt")), F.concat("s_suppkey", F.lit("_a.pdf")))).alias("file"))
    return documents.with_source_text(documents.pair_files(gold, found), texts).select("file", "section", "run", "source")


@query("""WITH m AS (SELECT l_suppkey % 20 AS d, 'run_' || l_linenumber AS run, round(avg(l_quantity::DOUBLE), 6) AS f1 FROM lineitem GROUP BY ALL) SELECT run, round(avg(f1), 6) AS f1, count(*) AS n_files FROM m GROUP BY run""")
def a10_run_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("d"), F.concat(F.lit("run_"), "l_linenumber").alias("run")).agg(F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("f1"))
    return reports.run_average(rows, "run", ["f1"]).withColumn("f1", F.round("f1", 6))


@query("""SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'A')::DOUBLE / nullif(count(*) FILTER (l_returnflag <> 'N'), 0) AS share FROM lineitem GROUP BY 1""")
def a18_rule_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")).alias("a"))
    return rows.select("k", parsing.rule_share(F.col("a")).alias("share"))


_RUNS = "SELECT l_suppkey % 12 + 1 AS d, l_linenumber AS run, trim(l_returnflag) AS section, round(avg(l_quantity::DOUBLE), 4) AS f1 FROM lineitem GROUP BY ALL"


@query(f"""WITH m AS ({_RUNS}) SELECT dense_rank() OVER (ORDER BY d)::INT AS doc_index, run::VARCHAR AS run_num, section, printf('%.2f/%.2f/%.2f', f1, f1 / 2, f1 / 4) AS cell FROM m WHERE section = 'A' AND run IN (1, 2, 3)""")
def p11_p14_o5_w6_f25_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section, three runs, no summary rows, documents by number, numbers as a report shows them."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.col("l_suppkey") % 12 + 1, F.lit("_doc.xml")).alias("file"), F.concat(F.lit("raw/run_"), "l_linenumber").alias("run_label"), F.trim("l_returnflag").alias("section")).agg(F.round(F.avg(F.col("l_quantity").cast("double")), 4).alias("f1"))
    whole = sinks.metric_rows(rows, ["f1"], overall=True).drop("level")
    kept = reports.detail_rows(reports.in_section(whole, "A")).where(F.col("run_num").isin(reports.RUNS))
    return kept.select("doc_index", "run_num", "section", reports.prf_cell(F.col("f1"), F.col("f1") / 2, F.col("f1") / 4).alias("cell"))


@query("""WITH k AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'raw' ELSE 'preprocessed' END AS kind, l_suppkey AS doc, l_linenumber AS run, round(avg(l_discount::DOUBLE), 6) AS score, count(*) FILTER (l_returnflag = 'A') AS m, count(*) AS g FROM lineitem GROUP BY ALL),
    s AS (SELECT kind, doc, avg(score) AS score, sum(m) AS m, min_by(g, run) AS g FROM k WHERE run <= 3 GROUP BY ALL) SELECT kind, round((SELECT avg(score) FROM k WHERE k.kind = s.kind AND run <= 3), 6) AS score, sum(m)::BIGINT AS matched, sum(g)::BIGINT AS gold FROM s GROUP BY kind""")
def r5_p13_correctness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores by kind of run; matched counts of all runs against the gold counts of each document's first."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.concat(F.when(F.col("l_linestatus") == "F", "raw").otherwise("preprocessed"), F.lit("_run"), "l_linenumber").alias("folder"), F.concat("l_suppkey", F.lit("_doc.bpmn")).alias("file"))
    rows = rows.agg(F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("score"), F.concat(F.count_if(F.col("l_returnflag") == "A"), F.lit("/"), F.count("*")).alias("absolute"))
    return reports.correctness_summary(rows, "score", "absolute").withColumn("score", F.round("score", 6))


@query("""WITH g AS (SELECT p_partkey % 50 AS k, p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 3 <> 0), f AS (SELECT p_partkey % 50 AS k, p_partkey AS id, upper(p_name) AS name FROM part WHERE p_partkey % 3 <> 1), h AS (SELECT g.k, g.id, g.name AS gn, f.name AS fn FROM g JOIN f ON f.id = g.id),
    l AS (SELECT k, 0 AS part, id, 'MATCH: ''' || gn || ''' with ''' || fn || ''' (1.00)' AS line FROM h UNION ALL SELECT k, 1, id, 'MISSING: ''' || name || '''' FROM g WHERE id NOT IN (SELECT id FROM h) UNION ALL SELECT k, 2, id, 'EXTRA: ''' || name || '''' FROM f WHERE id NOT IN (SELECT id FROM h))
    SELECT k, string_agg(line, chr(10) ORDER BY part, CASE part WHEN 0 THEN 0 ELSE id END, line) AS details FROM l GROUP BY k""")
def r6_j30_match_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("k"), F.col("p_partkey").cast("int").alias("id"), F.col("p_name").alias("name"))
    gold, found = part.where("id % 3 <> 0").select("k", F.col("id").alias("j"), "name"), part.where("id % 3 <> 1").select("k", F.col("id").alias("i"), F.upper("name").alias("name"))
    matches = assign.greedy(found.select("k", "i").join(gold.select("k", F.col("j")), "k").where("i = j").withColumn("score", F.lit(1.0)), ["k"], 0.5)
    return process_evaluation.match_details(found, gold, matches, ["k"])
