"""Operators on literals with hand-made expectations, sources on small documents, queries against their oracles."""

import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright import catalogue, catalogue_documents, catalogue_language, catalogue_models  # noqa: F401
from clausewright.functions import metrics, rules, similarity
from clausewright.operators import assign, bags, parsing, segment
from clausewright.plans import evaluation
from clausewright.sources import documents

SMALL = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("counts, want", [((3, 1, 2), (0.75, 0.6, 0.6667)), ((0, 0, 0), (1.0, 1.0, 1.0)), ((0, 2, 0), (0.0, 0.0, 0.0)), ((0, 0, 3), (0.0, 0.0, 0.0))])
def test_prf(spark, counts, want):
    df = spark.createDataFrame([counts], "tp int, fp int, fn int")
    assert tuple(df.select(*metrics.prf(F.col("tp"), F.col("fp"), F.col("fn"))).first()) == want


PAIRS = [("k", 0, 0, 0.90), ("k", 0, 1, 0.85), ("k", 1, 0, 0.88), ("k", 1, 1, 0.10)]


@pytest.mark.parametrize("method, want", [(assign.greedy, {(0, 0)}), (assign.gold_order, {(0, 0)}), (assign.optimal, {(0, 1), (1, 0)})])
def test_assignment(spark, method, want):
    df = spark.createDataFrame(PAIRS, "k string, i int, j int, score double")
    assert {(r.i, r.j) for r in method(df, ["k"], 0.8).collect()} == want


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_hungarian_is_optimal(n, m, seed):
    from itertools import permutations

    score = np.random.default_rng(seed).random((n, m))
    pairs = assign.hungarian(score)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == min(n, m)
    best = max(sum(score[i, j] for i, j in zip(p, range(m))) if n >= m else sum(score[i, j] for i, j in zip(range(n), p)) for p in permutations(range(max(n, m)), min(n, m)))
    assert abs(sum(score[i, j] for i, j in pairs) - best) < 1e-9


@pytest.mark.parametrize("a, b, blank, want", [("Board", "board", True, 1.0), ("Board", "Management Board", True, 0.92), ("", "", True, 1.0), ("", "x", True, 0.0), ("", "x", False, 0.92)])
def test_name_similarity(spark, a, b, blank, want):
    assert one(spark, similarity.name_similarity(F.col("a"), F.col("b"), blank), a=a, b=b) == want


def test_bag(spark):
    gold = spark.createDataFrame([("k", "e")], "k string, v string")
    found = spark.createDataFrame([("k", "e"), ("k", "e")], "k string, v string")
    assert tuple(bags.bag_counts(gold, found, ["k"], ["v"]).first()) == ("k", 1, 1, 0)


def test_carry_and_as_of(spark):
    rows = spark.createDataFrame([("d", 0, "A"), ("d", 1, None), ("d", 2, "B"), ("d", 3, None)], "d string, n int, actor string")
    assert [r.last for r in segment.carry_forward(rows, ["d"], ["n"], "actor", "last").orderBy("n").collect()] == [None, "A", "A", "B"]
    marks = spark.createDataFrame([("d", 1, "1"), ("d", 50, "2")], "d string, at int, p string")
    at = spark.createDataFrame([("d", 0), ("d", 49), ("d", 50)], "d string, at int")
    assert [r.p for r in segment.as_of(at, marks, ["d"], "at", "p", "UNKNOWN").orderBy("at").collect()] == ["UNKNOWN", "1", "2"]


@pytest.mark.parametrize("text, want", [("The board shall meet.", True), ("Dismay is common.", False), ("It is REQUIRED TO act.", True)])
def test_obligation(spark, text, want):
    assert one(spark, rules.obliges(F.col("t")), t=text) is want


def test_text_rules(spark):
    assert one(spark, rules.drop_fillers(F.col("t")), t="They shall, inter alia, report") == "They shall report"
    assert one(spark, rules.drop_dangling(F.col("t")), t="It acts pursuant to.") == "It acts."
    assert one(spark, rules.internal_references(F.col("t")), t="see paragraph  3 and Annex IV") == ["paragraph 3", "Annex IV"]
    assert one(spark, rules.normalize_spaces(F.col("t")), t=", the  Commission shall act ( a ).\n\n\n\n ;: report , b ") == "the Commission shall act (a).\nreport , b"
    assert one(spark, rules.article_numbers(F.col("t")), t="Articles 51, 52(1) and 54") == ["51", "52(1)", "54"]
    assert one(spark, rules.clean_label(F.col("t")), t="1(a) However, file it") == "However, file it"
    assert one(spark, rules.infer_type(F.col("t")), t="Data protection officer") == "ROLE"
    assert one(spark, rules.deontic_type(F.col("t")), t="May not") == "prohibition"


def test_tasks_and_actors(spark):
    df = spark.createDataFrame([(1, "The process has the following actors: Bank, Clerk and Board. The Clerk shall file it; the Board may not object.\n- The Bank must pay.")], "doc_id long, text string")
    assert df.select(segment.stated_actors(F.col("text")).alias("a")).first().a == ["Bank", "Clerk", "Board"]
    assert {(r.deontic, r.activity) for r in segment.tasks(df).collect()} == {("shall", "file it"), ("may not", "object"), ("must", "pay")}


def test_parsers(spark):
    assert one(spark, parsing.tagged(F.col("t"), "FINAL_LIST"), t="x <final_list> a </final_list>") == "a"
    assert one(spark, parsing.tagged(F.col("t"), "FINAL_LIST"), t="all") == "all"
    assert one(spark, parsing.listed(F.col("t")), t="a;; b ;;") == ["a", "b"]
    assert one(spark, parsing.unfenced(F.col("t")), t="so: ```xml\n<a/>\n```") == "<a/>"


ORGANISATION = """<?xml version="1.0"?><organisation xmlns="http://example.org/o"><units><unit id="Board"/><unit id=" "/></units>
<roles><role id="Clerk"><parent>Chief</parent></role><role id="Chief"/></roles>
<subjects><subject id="c" uid="cls"><relation unit="Board" role="Clerk"/><relation unit="Board" role="Chief"/></subject></subjects></organisation>"""


def test_organigram_scan(spark):
    got = documents.organigrams(spark.createDataFrame([("m", ORGANISATION), ("bad", "<x")], "model_id string, xml string"))
    assert {(r.name, r.parent) for r in got["roles"].collect()} == {("Clerk", "Chief"), ("Chief", None)}
    assert [r.name for r in got["units"].collect()] == ["Board"] and got["bindings"].count() == 2


def test_organigram_round_trip(spark):
    first = documents.organigrams(spark.createDataFrame([("m", ORGANISATION)], "model_id string, xml string"))
    again = documents.organigrams(documents.organigram_xml(first["units"], first["roles"], first["bindings"]))
    for part in ("units", "roles", "bindings"):
        kept = [c for c in first[part].columns if c not in ("ord", "par")]
        assert first[part].orderBy("ord").select(*kept).collect() == again[part].orderBy("ord").select(*kept).collect()


def test_task_scan(spark):
    xml = '<tasks><task id="t1"><label>File it</label><performers><performer><role>Clerk</role></performer><performer/></performers><deontic type="Obligation" modality="shall"/><conditions><condition>if late</condition></conditions><source-ref article="5" paragraph="1"/></task><task id="t2"><label> </label></task></tasks>'
    rows = documents.tasks(spark.createDataFrame([("m", xml)], "model_id string, xml string")).collect()
    assert len(rows) == 1 and rows[0].deontic_type == "obligation" and rows[0].performers[0].role == "Clerk" and len(rows[0].performers) == 1 and rows[0].source_article == "5"


def test_bpmn_scan(spark):
    xml = '<definitions xmlns="http://example.org/b"><collaboration><participant id="p" name="Bank" processRef="pr"/></collaboration><process id="pr"><laneSet><lane id="l" name="Desk"><flowNodeRef>a</flowNodeRef></lane></laneSet><task id="a" name="Pay"/><exclusiveGateway id="g"/><sequenceFlow id="f" sourceRef="a" targetRef="g"/><startEvent id="s"/></process></definitions>'
    elements = documents.bpmn_elements(spark.createDataFrame([("m", xml), ("bad", "<")], "model_id string, xml string"))
    assert tuple(documents.bpmn_counts(elements).first()) == ("m", 1, 1, 1, 1, 1)
    assert elements.where("tag = 'flowNodeRef'").first().lane == "Desk"


def test_file_scan_and_pairs(spark, tmp_path):
    for p, data in (("gold/1_a.txt", b"gold"), ("pred/raw/run_1/1_a.txt", "né ".encode("latin-1")), ("pred/raw/run_1/2_b.txt", b"x")):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_bytes(data)
    found = documents.read_texts(spark, str(tmp_path / "pred"))
    rows = documents.pair_files(documents.read_texts(spark, str(tmp_path / "gold")), found).collect()
    assert [(r.file, r.section, r.run) for r in rows] == [("1_a.txt", "raw", "run_1")]
    assert found.where("file = '1_a.txt'").first().text == "né"


def test_entity_scores(spark):
    found = spark.createDataFrame([("k", 0, "board"), ("k", 1, "Clerk"), ("k", 2, "zzz")], "k string, i int, name string")
    gold = spark.createDataFrame([("k", 0, "Management Board"), ("k", 1, "clerk")], "k string, j int, name string")
    row = evaluation.entity_scores(found, gold, ["k"]).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall, row.avg_similarity) == (2, 1, 0, 0.6667, 1.0, 0.96)
    assert tuple(evaluation.role_coverage(found, gold, ["k"]).first()) == ("k", 2, 2)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in catalogue.TABLES:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = db.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    want = found.fetchall()
    df = catalogue.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    tidy = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted((tidy(r) for r in df.select(names).collect()), key=repr) == sorted((tidy(r) for r in want), key=repr)
    assert want
