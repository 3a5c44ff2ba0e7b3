"""Rules of the format on literals: vectors, names, modalities, plans, performers, charts and worklists."""

import math

from pyspark.sql import functions as F

from clausewright.functions import rewriting
from clausewright.operators import candidates, entities, parsing, testset, vectors
from clausewright.sources import documents


def test_vectors_that_take_no_part(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", None), (3, "a", [1.0, 1.0]), (4, "a", [1.0, None]), (5, "a", [math.nan, 1.0]), (6, "a", [1.0, 2.0, 3.0]), (7, "a", [3.0, 2.0, 1.0]), (8, "a", []), (9, None, [1.0, 0.0]), (None, "a", [1.0, 0.0]), (10, "a", [0.0, 0.0]), (3, "a", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "i long, label string, v array<double>").repartition(3)
    got = sorted((r.a, r.b, round(r.score, 6)) for r in vectors.cosine_pairs(df, "label", "i", "v").collect())
    half = round(math.sqrt(0.5), 6)
    assert got == sorted([(1, 3, half), (1, 3, half), (1, 10, 0.0), (3, 10, 0.0), (3, 10, 0.0), (6, 7, round(10 / 14, 6))])
    assert vectors.cosine_pairs(df.limit(0), "label", "i", "v").count() == 0


def test_nested_institutions(spark):
    df = spark.createDataFrame([(1, "The European Council met; councils and the ecb did not."), (2, None), (3, "")], "doc_id int, text string")
    assert {(r.doc_id, r.name) for r in candidates.institutions(df).collect()} == {(1, "European Council"), (1, "Council"), (1, "ecb")}


def test_required_is_one_modality(spark):
    df = spark.createDataFrame([(1, "Operators are  required to keep a record."), (2, "The operator is required to file it.")], "doc_id int, text string")
    assert {(r.doc_id, r.deontic_modality, r.deontic_type) for r in candidates.task_candidates(df).collect()} == {(1, "is required to", "obligation"), (2, "is required to", "obligation")}


def test_plan_precedence_and_dangling(spark):
    tokens = [(0, "It", " "), (1, "shall", " "), (2, "act", " "), (3, "with", ""), (4, ".", "")]
    df = spark.createDataFrame([(tokens, [], {0: "Board"}, {0: "also", 1: "then"}), (tokens, [2], {2: "x"}, {2: "y"})], "t array<struct<i:int,text:string,ws:string>>, r array<int>, s map<int,string>, n map<int,string>")
    assert [r.x for r in df.select(rewriting.apply_plan(*map(F.col, "trsn")).alias("x")).collect()] == ["Board shall then act.", "It shall."]


def test_performers_once_in_order(spark):
    said = "unit: B, role: R ;; the desk ;; A/R ;; B/R ;; the desk ;; unit: A, role: R"
    df = spark.createDataFrame([(1, 0, said), (1, 1, None)], "doc_id int, task_no int, said string")
    tasks = df.select("doc_id", "task_no", parsing.performers(F.col("said")).alias("performers"))
    assert [(p.unit, p.role, p.text) for p in tasks.first().performers] == [("B", "R", "unit: B, role: R"), (None, None, "the desk"), ("A", "R", "A/R")]
    known = spark.createDataFrame([(1, 0, "Desk", "Clerk"), (1, 1, "B", "R")], "doc_id int, subject_no int, unit string, role string")
    got = [(r.ord, r.unit, r.role) for r in entities.task_performers(tasks, known).orderBy("ord").collect()]
    assert got == [(0, "B", "R"), (1, "Desk", "Clerk"), (2, "A", "R")]


def test_chart_namespace_and_permissions(spark):
    units = spark.createDataFrame([(1, "Board", None, 0, 0), (1, "Desk", "Board", 1, 0)], "model_id int, name string, parent string, ord int, par int")
    roles = spark.createDataFrame([(1, "Clerk", None, 0, 0)], units.schema)
    people = spark.createDataFrame([(1, "S", "u1", "Desk", "Clerk", 0)], "model_id int, subject string, uid string, unit string, role string, ord int")
    from xml.etree import ElementTree

    xml = documents.organigram_xml(units, roles, people)
    root = ElementTree.fromstring(xml.first().xml)
    ns = "{http://cpee.org/ns/organisation/1.0}"
    assert root.tag == f"{ns}organisation" and [u.get("id") for u in root.findall(f"{ns}units/{ns}unit")] == ["Board", "Desk"]
    assert [[c.tag.removeprefix(ns) for c in u] for u in [*root.iter(f"{ns}unit"), *root.iter(f"{ns}role")]] == [["permissions"], ["parent", "permissions"], ["permissions"]]
    read = documents.organigrams(xml)
    assert {(r.name, r.parent) for r in read["units"].collect()} == {("Board", None), ("Desk", "Board")}


def test_worklist_names_its_instance(spark):
    from xml.etree import ElementTree

    roles = spark.createDataFrame([("j", 0, "c1", "file", "R", "U"), ("j", 1, "c2", "close", "R", "U")], "job_id string, ord int, call_id string, label string, role string, unit string")
    read = lambda df: [t.get("instance_uuid") for t in ElementTree.fromstring(df.first().xml).iter("task")]
    made = read(testset.worklist_xml(roles, F.lit("o"), "https://example.org/"))
    assert len(made) == 2 and len(set(made)) == 1 and len(made[0]) == 36 and made == read(testset.worklist_xml(roles, F.lit("o"), "https://example.org/"))
    assert read(testset.worklist_xml(roles, F.lit("o"), "https://example.org/", instance=F.lit("given"))) == ["given", "given"]
