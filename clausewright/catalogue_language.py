"""Registered queries over sentences: arcs, references as spans, names, and the formats of charts, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query, read
from .catalogue_models import _charts
from .functions import rules
from .functions.rewriting import REFERENCE_MARKERS
from .functions.rules import ACT_TYPES
from .operators import assembly, candidates, grammar, references
from .sources import documents


def _made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(f"SELECT o_orderkey AS doc_id, {text} AS text FROM parquet.`{sf_dir}/orders.parquet`")


# --- references ---------------------------------------------------------------------------------------------------
_REFERRING = """CASE o_orderkey % 9 WHEN 0 THEN concat('The Board shall act in accordance with Article 5(2) and regulation (EU) 2016/679 of file ', o_orderkey, '.')
    WHEN 1 THEN concat(o_orderkey, ': as referred to in Article 5 or Article 7, and under section dealing with point declared.')
    WHEN 2 THEN concat('File ', o_orderkey, ' pursuant to Implementing Regulation (EC) 2009/136/EC and Directive 95/46/EC.')
    WHEN 3 THEN concat(o_orderkey, ' under Annex IV, point 3 and listed in Articles 5, 6 and 8(1).')
    WHEN 4 THEN concat('IAW Art. 3 and Art. IV; Article 9 of ', o_orderkey, '.')
    WHEN 5 THEN concat('under it the operator of batch ', o_orderkey, ' and all that goes with it too, Articles 5 and 6.')
    WHEN 6 THEN concat('laid down in the Article 2 and paragraph II; Section D of decision (Euratom) No. 7/2001 and ', o_orderkey, '.')
    WHEN 7 THEN concat(o_orderkey, ' has no reference.')
    ELSE concat('Article 4, paragraph 2 pursuant to Article 4, paragraph 2, ', o_orderkey, '.') END"""
_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_NUM, _ROM = r"regexp_full_match({}, '\d+')", r"regexp_full_match({}, '\d+|[IVXLCDM]{{1,10}}')"
_TOKENS_SQL = rf"""d AS (SELECT o_orderkey AS doc_id, {_REFERRING} AS t FROM orders),
    p AS (SELECT doc_id, t, regexp_extract_all(t, '\s+|[A-Za-z0-9]+|[^A-Za-z0-9\s]') AS x FROM d),
    q AS (SELECT doc_id, t, x[i] AS tok, i, sum(len(x[i])) OVER (PARTITION BY doc_id ORDER BY i) - len(x[i]) AS s FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM p)),
    k AS (SELECT doc_id, any_value(t) AS t, list(tok ORDER BY i) AS tok, list(s::INTEGER ORDER BY i) AS s FROM q WHERE NOT regexp_matches(tok, '^\s') GROUP BY doc_id),
    w AS (SELECT *, list_transform(tok, lambda x: lower(x)) AS low, unnest(range(1, len(tok) + 1)) AS n FROM k),
    m AS (SELECT DISTINCT doc_id, n + len(mw) AS last FROM w, (SELECT string_split(lower(unnest([{_quoted(REFERENCE_MARKERS)}])), ' ') AS mw) WHERE low[n:n + len(mw) - 1] = mw),
    i AS (SELECT *, unnest(list_filter([CASE WHEN low[n] IN ({_quoted(references.REFERENCE_TYPES)}) AND {_ROM.format("tok[n + 1]")} THEN 2 END, CASE WHEN low[n] = 'art' AND tok[n + 1] = '.' AND {_ROM.format("tok[n + 2]")} THEN 3 END,
        CASE WHEN low[n] = 'annex' AND {_ROM.format("tok[n + 1]")} AND tok[n + 2] = ',' AND low[n + 3] = 'point' AND {_NUM.format("tok[n + 4]")} THEN 5 END,
        CASE WHEN low[n] = 'article' AND {_NUM.format("tok[n + 1]")} AND tok[n + 2] = '(' AND {_NUM.format("tok[n + 3]")} AND tok[n + 4] = ')' THEN 5 END,
        CASE WHEN low[n] = 'article' AND {_NUM.format("tok[n + 1]")} AND tok[n + 2] = ',' AND low[n + 3] = 'paragraph' AND {_NUM.format("tok[n + 4]")} THEN 5 END], lambda x: x IS NOT NULL)) AS z FROM w),
    a AS (SELECT w.*, n + len(aw) AS c FROM w, (SELECT string_split(lower(unnest([{_quoted(ACT_TYPES)}])), ' ') AS aw) WHERE low[n:n + len(aw) - 1] = aw AND tok[n + len(aw)] = '(' AND tok[n + len(aw) + 1] IN ('EU', 'EC', 'Euratom') AND tok[n + len(aw) + 2] = ')'),
    b AS (SELECT *, CASE WHEN tok[c + 3] IN ('No', 'no') THEN c + 4 + CASE WHEN tok[c + 4] = '.' THEN 1 ELSE 0 END ELSE c + 3 END AS f, tok[c + 3] IN ('No', 'no') AS numbered FROM a),
    e AS (SELECT *, unnest(CASE WHEN NOT numbered AND tok[f + 3] = '/' AND tok[f + 4] IN ('EU', 'EC') THEN [f + 3 - n, f + 5 - n] ELSE [f + 3 - n] END) AS z FROM b WHERE {_NUM.format("tok[f]")} AND tok[f + 1] = '/' AND {_NUM.format("tok[f + 2]")}),
    l AS (SELECT *, regexp_extract(substr(t, s[n] + 1), '^(?i:Articles?)\s+(\d+(?:\(\d+\))?(?:\s*,\s*\d+(?:\(\d+\))?)*(?:\s*and\s*\d+(?:\(\d+\))?)?)', 1) AS said, lower(substr(t, greatest(0, s[n] - 60) + 1, least(60, s[n]))) AS ahead FROM w WHERE low[n] IN ('article', 'articles')),
    o AS (SELECT ['2', '6'] AS own)"""
_SAID = r"regexp_replace(substr(t, s[n] + 1, s[n + z - 1] + len(tok[n + z - 1]) - s[n]), '\s+', ' ', 'g')"


@query(rf"""WITH {_TOKENS_SQL}
    SELECT doc_id, {_SAID} AS reference, s[n] AS start, NOT list_contains(own, regexp_extract({_SAID}, '\d+|[IVXLCDM]{{1,10}}')) AS external FROM i, o WHERE EXISTS (SELECT 1 FROM m WHERE m.doc_id = i.doc_id AND m.last IN (i.n, i.n - 1))
    UNION SELECT doc_id, {_SAID}, s[n], true FROM e
    UNION SELECT doc_id, 'Article ' || num, place, true FROM (SELECT doc_id, s[n] AS place, unnest(list_filter(regexp_extract_all(said, '\d+(?:\(\d+\))?'), lambda x: NOT list_contains(own, x))) AS num FROM l, o
        WHERE said <> '' AND len(list_filter([{_quoted(m.lower() for m in REFERENCE_MARKERS)}], lambda y: contains(ahead, y))) > 0)""")
def f9_f12_reference_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every reference; the oracle says the token rules over DuckDB's own tokens."""
    rows = _made(spark, sf_dir, _REFERRING).withColumn("own", F.array(F.lit("2"), F.lit("6")))
    return references.reference_rows(rows, ["doc_id"], "text", "own").select("doc_id", "reference", "start", "external").distinct()


# --- arcs ---------------------------------------------------------------------------------------------------------
_GUARDED = """CASE o_orderkey % 8 WHEN 0 THEN concat('The Board shall verify that the file of batch ', o_orderkey, ' is complete.')
    WHEN 1 THEN concat('The Board shall publish the report which the importer adopted for batch ', o_orderkey, '.')
    WHEN 2 THEN concat('The Board shall file the record ', o_orderkey, ' that was made in time.')
    WHEN 3 THEN concat('The Board shall file the record ', o_orderkey, ' that it made in time.')
    WHEN 4 THEN concat('The Board shall vote on batch ', o_orderkey, ', including where necessary, twice.')
    WHEN 5 THEN concat('The Board shall vote on batch ', o_orderkey, ', including by letter.')
    WHEN 6 THEN concat('The importer and the operator shall check and sign the file and the list of batch ', o_orderkey, '.')
    ELSE concat('The importer or the operator may appeal against the plan that the measure ', o_orderkey, ' made.') END"""


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 8 WHEN 0 THEN 'The Board shall verify that the file of batch ' || o_orderkey || ' is complete.' WHEN 1 THEN 'The Board shall publish the report which the importer adopted for batch ' || o_orderkey || '.'
    WHEN 2 THEN 'The Board shall file the record ' || o_orderkey || '.' WHEN 3 THEN 'The Board shall file the record ' || o_orderkey || '.' WHEN 4 THEN 'The Board shall vote on batch ' || o_orderkey || ' twice.' WHEN 5 THEN 'The Board shall vote on batch ' || o_orderkey || ', including by letter.'
    WHEN 6 THEN 'The importer AND the operator shall check AND sign the file and the list of batch ' || o_orderkey || '.' ELSE 'The importer OR the operator may appeal against the plan.' END AS text FROM orders""")
def n2_n6_n10_f13_guarded_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause text whose lines hang on arcs: complements and clauses in which somebody acts stay, others go (also one whose subject is a
    pronoun or an ignored word), an ``including`` phrase goes without a noun, and coordinators of subjects and of the modal's verbs are marked."""
    return assembly.clause_text(_made(spark, sf_dir, _GUARDED))


_TASKED = """CASE o_orderkey % 6 WHEN 0 THEN concat('The Commission shall ensure that providers keep record ', o_orderkey, '.')
    WHEN 1 THEN concat('If the importer objects, the Board and the Council may not assess or approve plan ', o_orderkey, '.')
    WHEN 2 THEN concat('The competent authority may request the operator to file plan ', o_orderkey, '.')
    WHEN 3 THEN concat('Operators are required to keep record ', o_orderkey, '.')
    WHEN 4 THEN concat('Report ', o_orderkey, ' shall be published by the Agency.')
    ELSE concat('It must vote on batch ', o_orderkey, '.') END"""
_TASK_ROWS = {
    0: [("ensure", "shall", "own", "ensure that keep record {}", "Commission", ""), ("keep", "shall", "handed", "that keep record {}", "providers", "")],
    1: [("assess", "may not", "own", "assess", "Board", "If the importer objects"), ("approve", "may not", "joined", "approve plan {}", "Board", "If the importer objects")],
    2: [("request", "may", "own", "request the operator file plan {}", "competent authority", ""), ("file", "shall", "requested", "file plan {}", "competent authority", "if requested")],
    3: [("keep", "is required to", "own", "keep record {}", "Operators", "")],
    4: [("published", "shall", "own", "published by the Agency", "Agency", "")],
    5: [("vote", "must", "own", "vote on batch {}", "", "")],
}


def _task_rows_sql() -> str:
    rows = [(k, *row) for k, found in _TASK_ROWS.items() for row in found]
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


@query(f"""SELECT o_orderkey AS doc_id, verb, modality, kind, replace(label, '{{}}', o_orderkey::VARCHAR) AS label, subjects, conditions FROM orders JOIN (VALUES {_task_rows_sql()}) v(k, verb, modality, kind, label, subjects, conditions) ON o_orderkey % 6 = k""")
def n18_n23_n25_modal_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, their phrases, subjects and conditions off the arcs: handed on, requested, joined, passive and required ones."""
    rows = grammar.modal_tasks(_made(spark, sf_dir, _TASKED), "text").select("doc_id", F.explode("tasks").alias("t"))
    return rows.select("doc_id", "t.verb", "t.modality", "t.kind", "t.label", F.array_join("t.subjects", ";").alias("subjects"), F.array_join("t.conditions", ";").alias("conditions"))


# --- names, spacing, charts -----------------------------------------------------------------------------------------
_BODIES = """CASE o_orderkey % 4 WHEN 0 THEN concat('The European Council and batch ', o_orderkey) WHEN 1 THEN 'the european commission; THE COMMISSION and the Court of Justice of the European Union'
    WHEN 2 THEN concat('Councillors of Member States of batch ', o_orderkey) ELSE 'EDPB, EBA/ESMA and the European Data Protection Supervisor' END"""


@query("""SELECT o_orderkey AS doc_id, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['European Council', 'Council'] WHEN 1 THEN ['european commission', 'commission', 'COMMISSION', 'Court of Justice', 'Court of Justice of the European Union']
    WHEN 2 THEN ['Member States'] ELSE ['EDPB', 'EBA', 'ESMA', 'European Data Protection Supervisor'] END) AS name, 'UNIT' AS actor_type FROM orders""")
def n14_nested_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body inside the name of another counts too."""
    return candidates.institutions(_made(spark, sf_dir, _BODIES))


@query("""SELECT o_orderkey AS doc_id, 'the Board (' || o_orderkey || ') acts ,' || chr(10) || 'report , b' AS text FROM orders""")
def f1_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat(' ,; the  Board (  ', o_orderkey, ' ) \tacts ,', chr(10), chr(10), chr(10), chr(10), ' .: report , b ')"
    return _made(spark, sf_dir, text).select("doc_id", rules.normalize_spaces(F.col("text")).alias("text"))


@query("""SELECT c_nationkey AS model_id, 'http://cpee.org/ns/organisation/1.0' AS namespace, true AS all_permitted FROM customer GROUP BY c_nationkey""")
def k2_chart_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts as written: the format's namespace, and permissions in every unit and role."""
    chart = _charts(spark, sf_dir)
    xml = documents.organigram_xml(chart["units"], chart["roles"], chart["bindings"])
    listed = F.regexp_count("xml", F.lit(r"<(?:unit|role)\s+id="))
    permitted = F.regexp_count("xml", F.lit(r"<permissions\s*/>|<permissions></permissions>"))
    return xml.select("model_id", F.regexp_extract("xml", r'<organisation\s+xmlns="([^"]*)"', 1).alias("namespace"), ((listed == permitted) & (listed > 0)).alias("all_permitted"))
