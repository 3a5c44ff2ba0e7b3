"""Diagrams, charts, task tables, descriptions, clause texts, candidates, answers, testsets and reports on literals."""

import pytest
from pyspark.sql import functions as F

from clausewright.functions import rewriting, rules
from clausewright.operators import assembly, assign, candidates, completion, entities, parsing, process_graph, testset
from clausewright.plans import description_evaluation, organigram_evaluation, process_evaluation, reports, task_evaluation
from clausewright.sources import documents, sinks


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("The Commission shall act.", "Commission"), ("Where needed, the Board and the Agency must act.", "Board and Agency"), ("It shall act.", None), ("The report shall be sent.", None), ("The Data Report shall be sent.", None), ("Nothing here.", None), ("", None)],
)
def test_explicit_actor(spark, text, want):
    assert one(spark, rewriting.explicit_actor(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("It shall apply under Article 9.", "It shall apply."), ("It shall apply under Article 21.", "It shall apply."), ("It shall apply under Article 2.", "It shall apply under Article 2.")],
)
def test_external_phrases(spark, text, want):
    assert one(spark, rules.drop_dangling(rewriting.external_reference_phrases(F.col("t"), F.array(F.lit("2")))), t=text) == want
    assert one(spark, rewriting.external_reference_phrases(F.col("t"), F.array().cast("array<string>")), t=text) == text


def test_token_plan(spark):
    df = spark.createDataFrame([([(0, "It", " "), (1, "shall", " "), (2, "not", " "), (3, "act", "")], [2], {0: "Board"}, {3: " now"})], "t array<struct<i:int,text:string,ws:string>>, r array<int>, s map<int,string>, n map<int,string>")
    assert df.select(rewriting.apply_plan(*map(F.col, "trsn")).alias("x")).first().x == "Board shall act now"


REGULATION = """Preamble.
Article 1

Scope
1. The Commission shall act. It must report under Article 9.
2. Members may:
(a)
meet;
(b)
vote.
Article 2

Ends
1. Nothing is said here."""


def test_clause_text(spark):
    docs = spark.createDataFrame([(1, REGULATION), (2, "The Board shall meet. Words."), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in assembly.clause_text(docs).collect()}
    assert got[1].split("\n") == ["Article 1: Scope", "1 The Commission shall act.", "Commission must report.", "--PARALLEL TASKS--", "2(a) Members may meet", "2(b) Members may vote", "--END OF PARALLEL TASKS--", "---", "Article 2: Ends"]
    assert got[2] == "The Board shall meet."
    assert [tuple(r) for r in assembly.reference_table(docs).collect()] == [(1, "Article 1.1", "Article 9")]


def test_candidates(spark):
    docs = spark.createDataFrame([(1, "1. The Commission shall ensure that operators report incidents.\n--MARK--\n2. If asked, the Data Owner may not file the plan and keep a copy.")], "doc_id long, text string")
    rows = candidates.task_candidates(docs).orderBy("n").collect()
    assert [(r.deontic_type, r.source_paragraph) for r in rows if r.deontic_type == "prohibition"] == [("prohibition", "2")] * 2
    assert {r.label for r in rows} >= {"ensure that operators report incidents", "file the plan", "keep a copy"}
    assert rows[-1].conditions == ["If asked"]
    assert {r.name for r in candidates.actor_candidates(docs).collect()} == {"Commission"}


DIAGRAM = """<definitions xmlns="http://example.org/b"><collaboration><participant id="p" name="Bank" processRef="pr"/></collaboration><process id="pr">
<laneSet><lane id="l" name="Desk"><flowNodeRef>a</flowNodeRef></lane></laneSet><task id="a" name="File claim"/><task id="b" name="Pay"/><exclusiveGateway id="g" name="Valid?"/>
<sequenceFlow id="f1" sourceRef="a" targetRef="g"/><sequenceFlow id="f2" name="yes" sourceRef="g" targetRef="b"/><sequenceFlow id="f3" name="no" sourceRef="g" targetRef="a"/></process></definitions>"""


def test_process_evaluation(spark):
    gold = documents.bpmn_elements(spark.createDataFrame([("m", DIAGRAM)], "model_id string, xml string"))
    found = documents.bpmn_elements(spark.createDataFrame([("m", DIAGRAM.replace('name="Pay"', 'name="Zzz"').replace('name="no"', 'name="qqqq"'))], "model_id string, xml string"))
    keys = ["model_id"]
    assert {(r.activity, r.actor) for r in process_graph.activity_actors(gold, keys).collect()} == {("File claim", "Desk"), ("Pay", "Bank")}
    scores = {r.kind: (r.matched, r.recall) for r in process_evaluation.completeness(found, gold, keys).collect()}
    # a condition is the name of an exclusive gateway that splits, not the label of a flow
    assert scores == {"actors": (2, 1.0), "activities": (1, 0.5), "conditions": (1, 1.0)}
    assert process_evaluation.actor_assignment(found, gold, keys).first().score == 0.5
    assert round(process_evaluation.control_flow(found, gold, keys).first().score, 4) == 0.6667
    assert process_evaluation.decision_logic(found, gold, keys).first().score == 1.0
    names = lambda e, n: process_graph.numbered(process_graph.element_names(e, keys).where("kind = 'activities'"), keys, ["ord"], n)
    matches = spark.createDataFrame([("m", 0, 0, 1.0)], "model_id string, i int, j int, score double")
    text = process_evaluation.match_details(names(found, "i"), names(gold, "j"), matches, keys).first().details
    assert text.split("\n") == ["MATCH: 'File claim' with 'File claim' (1.00)", "MISSING: 'Pay'", "EXTRA: 'Zzz'"]


def test_chart_evaluation(spark):
    def chart(roles, bound):
        return {
            "units": spark.createDataFrame([("m", "Agency", None)], "model_id string, name string, parent string"),
            "roles": spark.createDataFrame([("m", r, p) for r, p in roles], "model_id string, name string, parent string"),
            "bindings": spark.createDataFrame([("m", str(n), u, r) for n, (u, r) in enumerate(bound)], "model_id string, subject string, unit string, role string"),
        }

    gold = chart([("Clerk", "Chief"), ("Chief", None)], [("Agency", "Clerk"), ("Agency", "Chief")])
    found = chart([("Senior Clerk", "Chief"), ("Chief", None), ("Xyz", None)], [("Agency", "Senior Clerk"), ("Agency", "Xyz")])
    got = {r.aspect: (r.tp, r.fp, r.fn) for r in organigram_evaluation.evaluate(found, gold, ["model_id"]).collect()}
    assert got["unit"] == (1, 0, 0) and got["role"] == (2, 1, 0) and got["role_hierarchy"] == (1, 0, 0)
    assert got["binding_by_names"] == (1, 1, 1) and got["binding"] == (1, 1, 1) and got["role_coverage"] == (1, 0, 1)


TASK = "model_id string, ord int, label string, performers array<struct<unit:string,role:string>>, deontic_type string, deontic_modality string, conditions array<string>, exceptions array<struct<_VALUE:string,_description:string,_ref:string>>, source_article string, source_paragraph string"


def test_task_evaluation(spark):
    gold = spark.createDataFrame([("m", 0, "File the plan", [("A", "Clerk")], "obligation", "shall", ["if late"], [], "1", "1"), ("m", 1, "Qqq", [("A", "Chief")], None, None, [], [], None, None)], TASK)
    found = spark.createDataFrame([("m", 0, "file the plan", [("A", "Clerk"), ("B", "Zed")], "permission", "may", [], [], "1", "1")], TASK)
    r = task_evaluation.evaluate(found, gold, ["model_id"]).first()
    assert (r.gold_tasks, r.pred_tasks, r.matched_tasks, r.performer_correctness) == (2, 1, 1, 0.5)
    assert (r.performer_micro_precision, r.performer_micro_recall, r.deontic_micro_f1, r.source_ref_micro_f1) == (0.5, 0.5, 0.0, 1.0)
    assert (r.condition_macro_f1, r.exception_micro_f1) == (0.0, 1.0)


def test_description_evaluation(spark):
    gold = spark.createDataFrame([(1, "The process has the following actors: Bank, Clerk and Board. The Clerk shall file it; the Board may not object.")], "k int, text string")
    found = spark.createDataFrame([(1, "The process has the following actors: Bank and Clerk. The Clerk may file it. If so, stop.")], "k int, text string")
    r = description_evaluation.evaluate(found, gold, ["k"]).first()
    assert (r.gold_actor_count, r.actor_precision, r.actor_recall) == (3, 1.0, 0.6667)
    assert (r.matched_tasks, r.task_precision, r.deontic_f1, r.xor_ratio) == (1, 1.0, 0.0, 0.0)


def test_answers_and_blocks(spark):
    class Fixed:
        def complete(self, requests, stage):
            return requests.withColumn("response", F.when(F.col("prompt") == "a", "<FINAL_TASKS>x</FINAL_TASKS>").when(F.col("prompt") == "b", "bare"))

    rows = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "p string, before string")
    got = completion.validated(rows, Fixed(), "tasks_validated", F.col("p"), "before", "after").collect()
    assert [r.after for r in got] == ["x", "bare", "old"]
    got = completion.Calls(lambda: lambda prompt, limit, heat: [" ", prompt, None, "!"]).complete(rows.withColumnRenamed("p", "prompt"), completion.STAGES["actors"])
    assert [r.response for r in got.collect()] == ["a!", "b!", "c!"]
    task = spark.createDataFrame([(1, "t1", "file it", [("U", "R")], "obligation", "shall", ["if late"], [("x", True)], "1", "2", ["R"])], "doc_id int, task_id string, label string, performers array<struct<unit:string,role:string>>, deontic_type string, deontic_modality string, conditions array<string>, exceptions array<struct<description:string,needs_cross_ref:boolean>>, source_article string, source_paragraph string, actors array<string>")
    blocks = parsing.task_blocks(task.select("doc_id", completion.task_block().alias("response"))).first()
    assert (blocks.label, blocks.deontic_type, blocks.deontic_modality, blocks.conditions, blocks.source_article, blocks.source_paragraph) == ("file it", "obligation", "shall", ["if late"], "1", "2")
    assert [tuple(p)[:2] for p in blocks.performers] == [("U", "R")] and [tuple(e) for e in blocks.exceptions] == [("x", True)]
    text = task.withColumn("exceptions", F.transform("exceptions", lambda e: e["description"])).select(completion.task_sentence().alias("x")).first().x
    assert text.split("\n") == ["[t1] R shall file it", "  CONDITION: if late", "  EXCEPTION: x", "  SOURCE: Article 1, §2"]


def test_entities(spark):
    actors = spark.createDataFrame([(1, 0, "Board", "UNIT"), (1, 1, "Clerk", "BOTH")], "doc_id int, line_no int, name string, actor_type string")
    answer = spark.createDataFrame([(1, "Clerk | Board | ROLE UNIT\nClerk | Chief | role\nBoard | Agency | UNIT\nClerk | X | OTHER")], "doc_id int, response string")
    built = entities.build_entities(actors, parsing.relation_lines(answer))
    assert {(r.name, r.entity_type, tuple(r.parents), tuple(r.unit_parents)) for r in built.collect()} == {("Board", "unit", ("Agency",), ()), ("Clerk", "role", ("Chief",), ("Board",))}
    assert [r.line for r in entities.relation_text(built).orderBy("ord").collect()] == ["Board | Agency | UNIT", "Clerk | Chief | ROLE", "Clerk | Board | ROLE-UNIT"]
    subjects = spark.createDataFrame([(1, "Board", "Clerk", 0), (1, "Agency", "Clerk", 1)], "doc_id int, unit string, role string, subject_no int")
    wanted = spark.createDataFrame([(1, 0, "the clerk"), (1, 1, "Nobody")], "doc_id int, task_no int, text string")
    got = {(r.task_no, r.unit, r.role) for r in entities.resolve_performers(wanted, subjects).collect()}
    assert got == {(0, "Board", "Clerk"), (0, "Agency", "Clerk"), (1, "Nobody", "Nobody")}


BLOCK = '<description xmlns="http://cpee.org/ns/description/1.0" xmlns:a="http://cpee.org/ns/annotation/1.0"><parallel a:x="1"><call id="c1" endpoint="user"><parameters><label>File it</label></parameters></call></parallel></description>'


def test_testset(spark):
    blocks = spark.createDataFrame([("j", BLOCK, "org", "form"), ("bad", "<x", "org", "form")], "job_id string, xml string, orgmodel string, form string")
    found = testset.calls(blocks)
    assert [(r.call_id, r.label, r.path) for r in found.collect()] == [("c1", "File it", ["description", "parallel"])]
    mapping = spark.createDataFrame([("j", 0, "Pay it", "Cashier", "Bank"), ("j", 1, "file it now", "Clerk", "Board")], "job_id string, task_no int, label string, role string, unit string")
    roles = testset.assign_roles(found, mapping, found)
    assert [(r.role, r.unit) for r in roles.collect()] == [("Clerk", "Board")]
    made = {r.job_id: r.xml for r in testset.enriched(blocks, roles).collect()}
    assert made["bad"] is None and "<role>Clerk</role>" in made["j"] and "annotation" not in made["j"]
    whole = one(spark, testset.testset_xml(F.col("x"), F.lit("w"), F.lit("o&o"), "maker"), x=made["j"])
    assert "    <description" in whole and "o&amp;o" in whole
    assert "<role>Clerk</role>" in testset.worklist_xml(roles, F.lit("org"), "https://example.org/").first().xml


def test_task_sink_round_trip(spark):
    xml = '<tasks><task id="t1"><label>File it</label><performers><performer><unit>U</unit><role>Clerk</role></performer></performers><deontic type="obligation" modality="shall"/><conditions><condition>if late</condition></conditions><exceptions><exception description="none"/></exceptions><source-ref article="5" paragraph="1"/></task></tasks>'
    first = documents.tasks(spark.createDataFrame([("m", xml)], "model_id string, xml string"))
    named = first.withColumn("exceptions", F.transform("exceptions", lambda e: F.struct(e["_description"].alias("description"), e["_ref"].alias("ref"))))
    again = documents.tasks(sinks.task_xml(named))
    columns = ["label", "performers", "deontic_type", "conditions", "source_article"]
    assert first.select(*columns).collect() == again.select(*columns).collect()


def test_tables_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("s", f"raw/run_{r}", f"{d}_x.xml", float(d + r)) for d in (1, 2) for r in (1, 2)], "section string, run_label string, file string, f1 double")
    levels = sinks.metric_rows(rows, ["f1"], overall=False, least_files=2).groupBy("level").count().collect()
    assert {(r.level, r["count"]) for r in levels} == {(0, 4), (1, 1)}
    sinks.write_table(rows, str(tmp_path / "t"), ["file", "f1", "absent"], ["file"])
    assert sinks.read_csv(spark, str(tmp_path / "t"), ["file"]).columns == ["file", "f1"]
    with pytest.raises(ValueError, match="gold"):
        sinks.read_csv(spark, str(tmp_path / "t"), ["gold"])
    means = reports.averaged(rows, ["f1"])
    assert {(r.doc_index, r.f1) for r in means.collect()} == {(1, 2.5), (2, 3.5), (None, 3.0)}
    text = reports.latex(means.where("doc_index is not null"), ["doc_index"], [F.col("doc_index").cast("string"), F.format_string("%.2f", "f1")], ["Doc", "F1"], "c", "l")
    assert "1 & 2.50 \\\\" in text and text.endswith("\\end{table}")
    assert [one(spark, c, t="3/7") for c in reports.absolute(F.col("t"))] == [3, 7]
    assert assign.hungarian is not None and "macro_avg" in sinks.metric_json(rows, ["f1"]).first().json
