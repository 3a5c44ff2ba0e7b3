"""Answers of a model, entities, diagrams and candidates: literals whose expectations come from the format's rules."""

from pyspark.sql import functions as F

from clausewright.functions import rules
from clausewright.operators import candidates, entities, parsing, process_graph
from clausewright.sources import documents


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, response string")


def test_relation_lines(spark):
    df = answers(spark, "Clerk | Chief | ROLE\n  Desk|Board|unit \nClerk | Desk | Role Unit\na | b\n | b | ROLE\na | b | THING", "a | b | UNIT\nnote: no_hierarchies here", "none")
    got = [tuple(r) for r in parsing.relation_lines(df).orderBy("doc_id", "line_no").select("doc_id", "child", "parent", "relation").collect()]
    assert got == [(0, "Clerk", "Chief", "ROLE"), (0, "Desk", "Board", "UNIT"), (0, "Clerk", "Desk", "ROLE-UNIT")]
    kept = parsing.relation_lines(df, reset=False).where("doc_id = 1").collect()
    assert [(r.child, r.parent, r.relation) for r in kept] == [("a", "b", "UNIT")]


def test_actor_lines(spark):
    df = answers(spark, "Clerk | role\nclerk | UNIT\nCLERK | ROLE\nBoard | Unit | x\nBoth | BOTH\nNobody | THING\nbare")
    got = [(r.name, r.actor_type) for r in parsing.actor_lines(df).orderBy("line_no").collect()]
    assert got == [("Clerk", "ROLE"), ("clerk", "UNIT"), ("Both", "BOTH")]


BLOCKS = """---TASK---
label: file it
LABEL: file the plan
performers: unit: Sales, role: Clerk ;; Board/Chief ;; the desk ;; (none) ;; /x ;; Board/Chief
conditions: if late ;; ;; if large
exceptions: unless closed [CROSS_REF];; [CROSS_REF] ;; when absent
article: 3: a
---END--- ---TASK---
deontic_type: permission
---END---
---TASK---
label:x
deontic_type:
---END---"""


def test_task_blocks(spark):
    first, second = parsing.task_blocks(answers(spark, BLOCKS)).orderBy("block_no").collect()
    assert (first.label, first.deontic_type, first.deontic_modality, first.source_article, first.source_paragraph) == ("file the plan", "obligation", "shall", "3: a", "UNKNOWN")
    assert [tuple(p) for p in first.performers] == [("Sales", "Clerk", "unit: Sales, role: Clerk"), ("Board", "Chief", "Board/Chief"), (None, None, "the desk")]
    assert first.conditions == ["if late", "if large"]
    assert [tuple(e) for e in first.exceptions] == [("unless closed", True), ("when absent", False)]
    assert (second.label, second.deontic_type, second.performers, second.exceptions) == ("x", "", [], [])


def test_performers_look_up(spark):
    subjects = spark.createDataFrame([(0, "Management Board", "Member", 0), (0, "Board", "Chair", 1), (0, "Desk", "Clerk", 2)], "doc_id int, unit string, role string, subject_no int")
    tasks = spark.createDataFrame([(0, 0, [(None, None, "Board")]), (0, 1, [(None, None, "the chair of it")]), (0, 2, [(None, None, "Nobody"), ("U", "R", "U/R"), ("U", "R", "U/R")])], "doc_id int, task_no int, performers array<struct<unit:string,role:string,text:string>>")
    got = {(r.task_no, r.unit, r.role) for r in entities.task_performers(tasks, subjects).collect()}
    # 'board' is held by 'management board', the first name of all; 'chair' is in 'the chair of it'
    assert got == {(0, "Management Board", "Member"), (1, "Board", "Chair"), (2, "Nobody", "Nobody"), (2, "U", "R")}


def test_exceptions_go_to_the_task_with_most_words(spark):
    tasks = spark.createDataFrame([(0, 1, "file the plan", ["if the board meets"]), (0, 2, "close the file", []), (0, 3, "notify the board", [])], "doc_id int, task_no int, label string, conditions array<string>")
    said = spark.createDataFrame([(0, 1, 0, "close the file", False), (0, 1, 1, "close the file", True), (0, 3, 0, "the board meets", True), (0, 3, 1, "qqq", True), (0, 2, 0, "notify file", True)], "doc_id int, task_no int, exc_no int, description string, needs_cross_ref boolean")
    got = {(r.task_no, r.exc_no): (r.ref_no, r.shared) for r in entities.resolve_exceptions(tasks, said).collect()}
    assert got == {(1, 0): (1, 0), (1, 1): (2, 2), (3, 0): (1, 2), (3, 1): (3, 0), (2, 0): (1, 1)}


ENTITY = "doc_id int, ord int, name string, entity_type string, parents array<string>, unit_parents array<string>"


def test_fallback_units(spark):
    rows = [(0, 0, "Office", "unit", [], []), (0, 1, "Clerk", "role", [], ["Desk", "Office"]), (0, 2, "Office", "role", [], []), (0, 3, "Desk", "role", [], []), (0, 4, "Chief", "role", [], []), (1, 0, "Chief", "role", [], ["External"])]
    got = {(r.doc_id, r.name, r.entity_type): tuple(r.unit_parents) for r in entities.with_fallback_units(spark.createDataFrame(rows, ENTITY)).collect()}
    assert got == {(0, "Office", "unit"): (), (0, "Clerk", "role"): ("Desk", "Office"), (0, "Office", "role"): (), (0, "Desk", "role"): (), (0, "Chief", "role"): ("External",), (0, "Desk", "unit"): (), (0, "External", "unit"): (), (1, "Chief", "role"): ("External",), (1, "External", "unit"): ()}


def test_subjects(spark):
    rows = [(0, 0, "Board", "unit", [], []), (0, 1, "Desk", "unit", [], []), (0, 2, "Vice-Chair of Board", "role", [], ["Desk", "Gone", "Board"]), (0, 3, "vi/channel", "role", [], []), (0, 4, "Desk", "role", [], []), (0, 5, "-", "role", [], [])]
    got = [(r.name, r.uid, r.unit, r.role) for r in entities.subjects(spark.createDataFrame(rows, ENTITY)).orderBy("ord").collect()]
    assert got == [
        ("vice_name board_surname", "vichs", "Desk", "Vice-Chair of Board"),
        ("vice_name board_surname", "vich2", "Board", "Vice-Chair of Board"),
        ("vi_name channel_surname", "vich3", "External", "vi/channel"),
        ("desk_name desk_surname", "des", "Desk", "Desk"),
        ("role_name role_surname", "ros", "External", "-"),
    ]


def test_picture_of_a_chart(spark):
    named = lambda rows: spark.createDataFrame(rows, "model_id string, name string, parent string, ord int")
    units = named([("m", "Board", None, 0), ("m", "Desk", "Board", 1), ("m", "Lone", "Gone", 2)])
    roles = named([("m", "Clerk", "Chief", 0), ("m", "Chief", None, 1), ("m", "Odd", "Nobody", 2)])
    bound = spark.createDataFrame([("m", "Desk", "Clerk"), ("m", "Board", "Chief"), ("m", "Board", "Chief"), ("m", "Gone", "Chief"), ("m", "Desk", "Odd")], "model_id string, unit string, role string")
    got = {(r.source, r.target, r.kind) for r in entities.hierarchy_edges(units, roles, bound).collect()}
    assert got == {("Board", "Desk", "unit"), ("Chief", "Clerk", "role"), ("Board", "Chief", "binding")}


DIAGRAM = """<definitions xmlns="http://example.org/b"><process id="p"><serviceTask id="s" name="Second"/><userTask id="u" name="First"/><task id="t" name="Zero"/>
<dataObject name="no"/><dataObjectReference name="yes"/><dataStoreReference name="no"/><inclusiveGateway id="i" name="wide"/><exclusiveGateway id="x" name="one way"/><exclusiveGateway id="y" name="two ways"/>
<sequenceFlow sourceRef="y" targetRef="s" name="a"/><sequenceFlow sourceRef="y" targetRef="u"/><sequenceFlow sourceRef="x" targetRef="t" name="b"/><sequenceFlow sourceRef="i" targetRef="t"/><sequenceFlow sourceRef="i" targetRef="u"/><sequenceFlow sourceRef="u" targetRef="x"/><sequenceFlow sourceRef="t" targetRef="y"/></process></definitions>"""


def test_order_and_kinds_of_elements(spark):
    elements = documents.bpmn_elements(spark.createDataFrame([("m", DIAGRAM)], "model_id string, xml string"))
    names = process_graph.numbered(process_graph.element_names(elements, ["model_id"]), ["model_id", "kind"], ["ord"], "n").orderBy("kind", "n").collect()
    listed = {k: [r.name for r in names if r.kind == k] for k in {r.kind for r in names}}
    assert listed == {"activities": ["Zero", "First", "Second"], "data_objects": ["yes"], "conditions": ["two ways"]}
    flows = process_graph.numbered(process_graph.control_flow(elements, ["model_id"]), ["model_id"], ["ord"], "n").orderBy("n").collect()
    assert [(r.source, r.target) for r in flows] == [("Zero", "two ways"), ("First", "one way"), ("one way", "Zero"), ("two ways", "Second"), ("two ways", "First"), ("wide", "Zero"), ("wide", "First")]


def test_names_and_paragraphs(spark):
    names = ["Data Protection Officer", "user", "Market Surveillance Authority", "Board", "the Works", "Co-operator"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.x for r in df.select(rules.infer_type(F.col("n")).alias("x")).collect()] == ["ROLE", "ROLE", "UNIT", "UNIT", "UNIT", "ROLE"]
    docs = spark.createDataFrame([(1, "2024. The Board shall act.\n1. The Board shall meet.\n12(a) The Board shall vote.\n3The Board shall rest.")], "doc_id long, text string")
    rows = candidates.task_candidates(docs).orderBy("at").collect()
    assert [(r.label, r.source_paragraph) for r in rows] == [("act", "UNKNOWN"), ("meet", "1"), ("vote", "12(a)"), ("rest", "12(a)")]
    shown = candidates.frequent_names(spark.createDataFrame([(1, "The Data Board shall act. A Data Board met. Then, Data Board shall end.")], "doc_id long, text string")).collect()
    assert ("Data Board", 2) in {(r.name, r.n_subject) for r in shown}


def test_most_similar_label(spark):
    """An equal label without case wins, the first of equal ones; else the most similar one."""
    from clausewright.operators import testset

    calls = spark.createDataFrame([("j", 0, "c0", "File Plan", ""), ("j", 1, "c1", "file the plans", ""), ("j", 2, "c2", "zzz", ""), ("k", 0, "c0", "file plan", "")], "job_id string, ord int, call_id string, label string, role string")
    mapping = spark.createDataFrame([("j", 2, "file plan", "second", "U2"), ("j", 1, "FILE plan", "first", "U1"), ("j", 3, "file the plan", "third", "U3")], "job_id string, task_no int, label string, role string, unit string")
    got = {(r.job_id, r.ord): (r.role, r.unit) for r in testset.assign_roles(calls, mapping, calls).collect()}
    assert got == {("j", 0): ("first", "U1"), ("j", 1): ("third", "U3"), ("j", 2): ("first", "U1"), ("k", 0): ("", "*")}
