"""Steps whose memory and work must not grow faster than their input."""

import re

import pytest
from pyspark.sql import functions as F

from clausewright.operators import candidates, name_join, segment, vectors
from clausewright.sources import documents


def test_elements_leave_in_batches_and_null_diagrams_give_no_row(spark):
    tasks = "".join(f'<task id="n{k}" name="t"/>' for k in range(2 * documents.ELEMENTS + 5))
    rows = [("large", f"<definitions><process id='p'>{tasks}</process></definitions>"), ("null", None), ("bad", "<a><b></a>"), ("small", "<definitions><process id='q'/></definitions>")]
    found = documents.bpmn_elements(spark.createDataFrame(rows, "model_id string, xml string").coalesce(1))
    places = {r[0]: sorted(r[1]) for r in found.groupBy("model_id").agg({"ord": "collect_list"}).collect()}
    assert places == {"large": list(range(2 * documents.ELEMENTS + 7)), "small": [0, 1]}
    assert found.where("tag = 'task' and process_id = 'p'").select("id").distinct().count() == 2 * documents.ELEMENTS + 5


def test_names_of_small_and_large_groups_meet_without_broadcast(spark):
    sides = []
    for side in "fg":
        rows = [("small", f"{side}{k} clerk {k}") for k in range(5)] + [("large", f"clerk {k % 7} {side} of desk {k}") for k in range(60)]
        rows += [("small", "clerk"), ("small", ""), ("large", "desk 1"), ("alone " + side, "clerk"), (None, "clerk"), ("small", None)]
        sides.append((rows, spark.createDataFrame(rows, f"k string, {side} string")))
    (a, left), (b, right) = sides
    met = name_join.holding(left, right, ["k"], "f", "g")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    want = {(k, x, y) for k, x in a for q, y in b if k is not None and k == q and x and y and (x in y or y in x)}
    assert len(want) > 12 and sorted(map(tuple, met.collect())) == sorted(want)
    close = name_join.alike(left, right, ["k"], "f", "g", 0.6, contained=False)
    grams = lambda s: {f"  {s}  "[i : i + 3] for i in range(len(s) + 2)}
    score = lambda x, y: len(grams(x) & grams(y)) / (len(grams(x)) * len(grams(y))) ** 0.5
    want = {(k, x, y) for k, x in a for q, y in b if k is not None and k == q and x is not None and y is not None and score(x, y) >= 0.6 - 1e-12}
    assert {tuple(r)[:3] for r in close.collect()} == want


def test_products_leave_blocks_only_at_the_threshold(spark):
    rows = [("a" if k % 3 else "b", k, [float((k * 7 + c) % 11) for c in range(3)]) for k in range(40)] + [("a", 90, [1.0, None, 2.0]), ("a", 91, [9.0, 9.0]), (None, 92, [9.0] * 3), ("a", 93, None), ("a", 94, [])]
    sides = [spark.createDataFrame(rows, f"k string, {side} int, v array<double>") for side in "ij"]
    found = vectors.product_pairs(*sides, "k", 120)
    whole = [(k, n, v) for k, n, v in rows if k and v and None not in v]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    want = sorted((k, i, j, dot(x, y)) for k, i, x in whole for q, j, y in whole if k == q and len(x) == len(y) and dot(x, y) >= 120)
    assert want and sorted(map(tuple, found.collect())) == want
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_descriptions_meet_in_one_join(spark):
    """Each text is read once, and pairs of texts are neither exploded nor shuffled again."""
    from clausewright.plans import description_evaluation

    texts = [(1, "Actors: Bank and Clerk. The Clerk shall file it; the Clerk shall file it; The Clerk shall file it. The Bank may pay."), (2, ""), (3, None), (4, " The Bank must pay the \n- The Clerk shall wait"), (5, "Actors: Bank.")]
    gold = spark.createDataFrame(texts, "k int, text string")
    found = spark.createDataFrame([(k, texts[-k][1]) for k, _ in texts], "k int, text string")
    rows = description_evaluation.evaluate(found, gold, ["k"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan and "Window" not in plan
    got = {r.k: (r.gold_task_count, r.pred_task_count, r.matched_tasks, r.gold_actor_count, r.actor_f1, r.gold_total_tokens) for r in rows.collect()}
    assert got == {1: (3, 0, 0, 2, 0.6667, 29), 2: (0, 2, 0, 0, 1.0, 0), 3: (0, 0, 0, 0, 1.0, None), 4: (2, 0, 0, 0, 1.0, 10), 5: (0, 3, 0, 1, 0.6667, 4)}


def test_name_score_is_the_similarity_of_names(spark):
    from clausewright.functions.similarity import name_score, name_similarity

    names = ["", "board", "board of it", "boards and men", "clerk", "größe", "a"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").select("a", "b", name_similarity(F.col("a"), F.col("b")).alias("s"))
    assert all(r.s == name_score(r.a, r.b) for r in rows.collect())


def test_calls_meet_their_roles_in_one_shuffle(spark):
    """Calls, stated roles and the mapping are dealt by job once, and nothing is written in between."""
    from clausewright.operators import testset

    found = spark.createDataFrame([("j", 0, "a", "File it", ""), ("j", 1, "b", "Pay", "Clerk"), ("j", 2, "b", "Pay it", "Chief"), ("j", 3, "c", "Pay", ""), ("j", 4, "d", "file IT", ""), ("k", 0, "a", "Odd", ""), (None, 0, "a", "File it", ""), ("j", 5, None, None, "")], "job_id string, ord int, call_id string, label string, role string")
    mapping = spark.createDataFrame([("j", 2, "file it", "Late", "L"), ("j", 1, "File It", "Early", "E"), ("j", 3, "other", "Clerk", ""), ("j", None, "Zzz", "None", "N"), (None, 1, "File it", "Nobody", "X")], "job_id string, task_no int, label string, role string, unit string")
    rows = testset.assign_roles(found, mapping, found)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = sorted(((r.job_id, r.ord, r.role, r.unit) for r in rows.collect()), key=str)
    want = [("j", 0, "Early", "E"), ("j", 1, "Chief", "*"), ("j", 2, "Chief", "*"), ("j", 3, "Clerk", "*"), ("j", 4, "Early", "E"), ("j", 5, "", "*"), ("k", 0, "", "*"), (None, 0, "", "*")]
    assert got == sorted(want, key=str)
    assert sorted(tuple(r) for r in testset.assign_roles(found.where("job_id = 'j' and ord < 2"), mapping, found.where("ord = 2")).select("ord", "role").collect()) == [(0, "Early"), (1, "Chief")]


def test_blocks_are_written_as_the_tree_writes_them(monkeypatch):
    from clausewright.operators import testset

    inner = '<call id="a&quot;&lt;&#10;b" a:note="1" endpoint="x"><parameters><label> P &amp; q </label></parameters></call>tail<loop> text <call/><stop/> </loop><empty> </empty><code>x &lt; y</code>'
    bare = f'<x:description xmlns:x="{testset.DESCRIPTION_NS}" xmlns:a="{testset.ANNOTATION_NS}">' + re.sub(r"<(/?)(\w)", r"<\1x:\2", inner) + "</x:description>"
    for text in (bare, f"<r xmlns='{testset.DESCRIPTION_NS}'><description>{inner.replace(' a:note="1"', '')}</description>after</r>", f"<description xmlns='{testset.DESCRIPTION_NS}'/>"):
        assert testset._plain(testset._block(text))
        args = lambda: (testset._block(text), "o & <m>", None, iter(["R&D"]))  # noqa: E731, B023
        quick = testset._rebuilt(*args())
        with monkeypatch.context() as m:
            m.setattr(testset, "_plain", lambda root: False)
            assert quick == testset._rebuilt(*args())


def test_worklists_shuffle_calls_not_texts(spark):
    from clausewright.operators import testset

    roles = spark.createDataFrame([("j", 0, "a", "x", "R", "U"), ("j", 1, "a", "x", "R", "V")], "job_id string, ord int, call_id string, label string, role string, unit string")
    rows = testset.worklist_xml(roles, F.lit("o"), "https://example.org/")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and rows.first().xml.count("<unit>U</unit>") == 1


def test_testsets_are_read_in_one_pass(spark):
    from clausewright.operators import testset

    block = f'<x:description xmlns:x="{testset.DESCRIPTION_NS}"><x:loop><x:call/></x:loop><x:call/></x:description>'
    whole = spark.createDataFrame([(1, block)], "k int, b string").select("k", testset.testset_xml(F.col("b"), F.lit("w&w"), F.lit(""), "me").alias("t")).union(spark.createDataFrame([(2, "<a>"), (3, None)], "k int, t string"))
    assert sorted(tuple(r) for r in testset.testset_facts(whole, "t").collect()) == [(1, "w&w", "", "me", 7, 2), (2, None, None, None, None, None), (3, None, None, None, None, None)]


def test_tokens_are_compared_only_with_phrases_of_their_first_word(monkeypatch):
    from clausewright.operators import references

    seen = []
    whole = references._citations
    monkeypatch.setattr(references, "_citations", lambda tokens, low, i: seen.append(low[i]) or whole(tokens, low, i))
    found = references.spans_of("The Board shall act " * 50 + "pursuant to Implementing Regulation (EU) 1/2020.")
    assert seen == ["implementing", "regulation"]
    assert [s["said"] for s in found if s["kind"] == references.CITATION] == ["Implementing Regulation (EU) 1/2020", "Regulation (EU) 1/2020"]


def test_names_of_diagrams_are_matched_in_one_join(spark):
    """Names leave the scan an array a diagram and kind, as the element table lists them; repeated names match once each."""
    from clausewright.operators import process_graph
    from clausewright.plans import process_evaluation

    flows = "".join(f'<sequenceFlow id="f{k}" sourceRef="{s}" targetRef="a"/>' for k, s in enumerate(["g", "g", "h", "e", "e", "x", "x"]))
    body = '<participant id="p" name=" Pool "/><lane name="L"/><userTask id="u" name="late"/><task id="a" name="b"/><task id="b" name="a"/><task id="c" name="b"/><task id="d" name=" "/><exclusiveGateway id="g" name="split"/><exclusiveGateway id="g" name="again"/><exclusiveGateway id="h" name="one"/><exclusiveGateway name="none"/><inclusiveGateway id="e" name="other"/><endEvent/>'
    whole = f'<d xmlns="http://example.org/b">{body}{flows}</d>'
    schema = "model_id int, xml string"
    gold = spark.createDataFrame([(1, whole), (2, whole), (3, None), (4, "<a><b></a>"), (5, '<d><task name="x"/></d>')], schema)
    found = spark.createDataFrame([(1, whole.replace('name="a"', 'name="b"')), (6, '<d><task name="x"/></d>')], schema)
    elements = process_graph.element_names(documents.bpmn_elements(gold), ["model_id"])
    want: dict = {}
    for r in elements.orderBy("ord").collect():
        want.setdefault((r.model_id, r.kind), []).append(r.name)
    assert {(r.model_id, r.kind): r.names for r in process_graph.diagram_names(gold).collect()} == want
    assert want[1, "activities"] == ["b", "a", "b", "late"] and want[1, "conditions"] == ["split", "again"]
    same = lambda a, b: (a == b).cast("double")
    rows = process_evaluation.completeness_of_names(process_graph.diagram_names(found), process_graph.diagram_names(gold), ["model_id"], same)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 2
    got = {(r.model_id, r.kind): (r.n_gold, r.n_found, r.matched, r.recall) for r in rows.collect()}
    assert got[1, "activities"] == (4, 4, 3, 0.75) and got[1, "conditions"] == (2, 2, 2, 1.0) and got[1, "actors"] == (2, 2, 2, 1.0)
    assert got[2, "activities"] == (4, 0, 0, 0.0) and got[5, "activities"] == (1, 0, 0, 0.0) and got[6, "activities"] == (0, 1, 0, 1.0) and len(got) == 8


def test_trees_are_found_once_a_worker(monkeypatch):
    """A later batch of sentences that differ in their numbers only looks for no tree, and what is kept is bounded."""
    from clausewright.functions import arcs
    from clausewright.operators import grammar

    first = arcs.parse(["The Board shall file plan 7 of batch 12.", None, "", "a; " * 90])
    looked = []
    find = arcs._find
    monkeypatch.setattr(arcs, "_find", lambda shapes: looked.append(shapes) or find(shapes))
    again = arcs.parse(["The Board shall file plan 345 of batch 6.", None, "", "a; " * 90])
    assert not looked and [[(w["tag"], w["head"], w["dep"]) for w in s] for s in again] == [[(w["tag"], w["head"], w["dep"]) for w in s] for s in first]
    assert [w["text"] for w in again[0]][4:8] == ["plan", "345", "of", "batch"] and again[0][5]["end"] == 29 and len(again[3]) == 180
    assert grammar._groups(["The Board shall file plan 345.", None]).to_pylist() == [[{"name": "Board", "verb": "file"}, {"name": "plan", "verb": None}], []]
    monkeypatch.setattr(arcs, "KNOWN", 2)
    for k in range(6):
        arcs.parse([f"The {'x' * (k + 1)} acts.", f"A {'y' * (k + 1)} acts.", f"An {'z' * (k + 1)} acts."][: 1 + k % 3])
        assert len(arcs._trees) <= 2
    assert len(arcs.parse(["The x acts.", "A y acts.", "An z acts."])) == 3


def test_texts_are_searched_for_institutions_once(spark):
    from clausewright.operators import candidates

    docs = spark.createDataFrame([(1, "THE COMMISSION and the Council; the council."), (2, None), (3, "none")], "doc_id int, text string")
    found = candidates.institutions(docs)
    assert "size(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.name) for r in found.collect()} == {(1, "COMMISSION"), (1, "Council"), (1, "council")}


def test_charts_are_parsed_once(spark):
    """Units, roles and bindings of a chart come from one parse of its XML, whichever of them are read."""
    xml = spark.createDataFrame([("m", '<organisation><units><unit id=" A "><parent> P </parent><parent/><parent>Q</parent></unit><unit id=" "/></units><roles><role id="R"/></roles><subjects><subject id="s" uid="u"><relation unit="A" role="R"/><relation unit="" role="R"/></subject><subject id="t"/></subjects></organisation>'), ("bad", "<x"), ("none", None)], "model_id string, xml string")
    chart = documents.organigrams(xml)
    plans = [rows._jdf.queryExecution().optimizedPlan().toString() for rows in chart.values()]
    assert not any("from_xml" in p or "xmltostructs" in p.lower() for p in plans)
    assert [tuple(r) for r in chart["units"].orderBy("par").collect()] == [("m", "A", "P", 0, 0), ("m", "A", "Q", 0, 1)]
    assert [tuple(r) for r in chart["roles"].collect()] == [("m", "R", None, 0, None)]
    assert [(r.model_id, r.subject, r.unit, r.role, tuple(r.ord), r.uid) for r in chart["bindings"].collect()] == [("m", "s", "A", "R", (0, 0), "u")]


def test_rewriting_searches_only_texts_that_can_match(spark):
    """Guards before patterns: the results are those of the patterns alone, and units are worked out once."""
    from clausewright.functions import rewriting, rules
    from clausewright.operators import assembly

    texts = ["a  b\tc \t d", " x ", "", None, "acts, WITHOUT undue delay, in\ttime", "inter in particular alia end", "For Example: it", "under article 9 and Article 2, Article 12(1).", "as referred to in Article 7", "no article", "\t", "Inter\u0130 alia"]
    rows = spark.createDataFrame([(k, t, ["2"]) for k, t in enumerate(texts)], "k int, t string, own array<string>")
    plain = F.col("t")
    for f in rules.FILLERS:
        plain = F.regexp_replace(plain, rf"(?i),?\s*{f},?\s*", " ")
    spaced = F.col("t")
    for p, to in [(r"[ \t]+", " "), *rules.SPACING[1:]]:
        spaced = F.regexp_replace(spaced, p, to)
    made = rows.select("t", rules.drop_fillers(F.col("t")).alias("a"), plain.alias("b"), rules.normalize_spaces(F.col("t")).alias("c"), rules.trim_all(spaced).alias("d"), rewriting.external_reference_phrases(F.col("t"), F.col("own")).alias("e"))
    got = made.collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and [r.e for r in got][7:10] == ["and Article 2.", "", "no article"]
    clauses = ["The report who\u0131ch, aS DEFINED in the list, ends.", "The file THAT it made ends.", "The file wh\u0131ch it made ends.", "The list as e\u017ftabl\u0131\u017fhed by it ends.", None, ""]
    kept = spark.createDataFrame([(k, t) for k, t in enumerate(clauses)], "k int, t string").select("k", rewriting.drop_relative_clauses(F.col("t")).alias("x")).orderBy("k").collect()
    assert [r.x for r in kept] == ["The report who\u0131ch, ends.", "The file.", "The file wh\u0131ch it made ends.", "The list.", None, ""]
    docs = spark.createDataFrame([(1, "Article 1\n\nScope\n1. The Board shall act.")], "doc_id int, text string")
    rows = assembly.clause_text(docs)
    assert "(?im)(?=^Article" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.first().text == "Article 1: Scope\n1 The Board shall act."


def test_vectors_go_to_few_pairs_of_blocks(spark, monkeypatch):
    """The blocks of a group do not grow in number with it, until they hold as much as one may; every pair is still found."""
    import pyarrow as pa

    def pairs_of_blocks(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_i").cast("int64"), batch.column("_j").cast("int64"), pa.array([0.0] * batch.num_rows)], ["a", "b", "score"])

    monkeypatch.setattr(vectors, "BLOCK", 2)
    rows = spark.createDataFrame([(k // 200, k, [float(k % 7 + 1), float(k % 11), 1.0]) for k in range(210)], "label int, vec_id long, v array<float>")
    found = {(r.a, r.b): r.score for r in vectors.cosine_pairs(rows, "label", "vec_id", "v").collect()}
    assert found.keys() == {(a, b) for a in range(210) for b in range(a + 1, 210) if a // 200 == b // 200}
    assert abs(found[0, 154] - 1) < 1e-9 and abs(found[200, 201] - 37 / (30 * 46) ** 0.5) < 1e-9
    monkeypatch.setattr(vectors, "_scores", pairs_of_blocks)
    assert vectors.cosine_pairs(rows, "label", "vec_id", "v").count() <= 12 * 13 // 2 + 5 * 6 // 2
    monkeypatch.setattr(vectors, "NUMBERS", 3 * 5)
    assert vectors.cosine_pairs(rows, "label", "vec_id", "v").count() > 30 * 31 // 2


def test_task_candidates_find_their_paragraphs_in_the_row(spark, monkeypatch):
    """Offsets and paragraphs take no window, sort or join; long arrays are summed by chunks."""
    monkeypatch.setattr(segment, "CHUNK", 3)
    long = "\n".join(f"{k}. It shall file form {k}." if k % 4 == 1 else "" if k % 4 == 2 else "It may pay." for k in range(50))
    docs = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "It shall act."), (4, "7. It must wait.\n--X--\nIt may act.")], "doc_id long, text string")
    rows = candidates.task_candidates(docs)
    whole, plan = (x._jdf.queryExecution().executedPlan().toString() for x in (rows, rows.drop("n")))
    assert whole.count("Exchange") == plan.count("Exchange") == 1 and not any(step in plan for step in ("Window", "Sort", "Join"))
    got = sorted((r.doc_id, r.at, r.n, r.label, r.source_paragraph) for r in rows.where("doc_id < 4").collect())
    lines, at, mark, want = long.split("\n"), 0, "UNKNOWN", []
    for k, line in enumerate(lines):
        mark = str(k) if k % 4 == 1 else mark
        if line:
            want.append((1, at, len(want), f"file form {k}" if k % 4 == 1 else "pay", mark))
        at += len(line) + 1
    assert got == want
    # texts of one id do not meet
    assert sorted((r.at, r.label, r.source_paragraph) for r in rows.where("doc_id = 4").collect()) == [(0, "act", "UNKNOWN"), (0, "wait", "7"), (23, "act", "7")]
    sums = spark.createDataFrame([([],), ([5],), (list(range(9)),), (list(range(10)),)], "a array<int>").select(segment.sums_before(F.col("a")).alias("s"))
    assert [r.s for r in sums.collect()] == [[], [0], [0, 0, 1, 3, 6, 10, 15, 21, 28], [0, 0, 1, 3, 6, 10, 15, 21, 28, 36]]


def test_flows_of_diagrams_are_matched_in_one_join(spark, monkeypatch):
    """The pairs that the element tables give, and scores by either similarity, without an element table or a written side."""
    import random

    from clausewright.operators import process_graph
    from clausewright.plans import process_evaluation
    from clausewright.sources import documents

    rnd = random.Random(11)
    names = ["check file", "check files", "send file", "close", " ", "Close"]

    def diagram(n):
        nodes = "".join(f'<{rnd.choice(["task", "startEvent", "exclusiveGateway", "dataObject"])} id="n{rnd.randint(0, k)}" name="{rnd.choice(names)}"/>' for k in range(n))
        flows = "".join(f'<sequenceFlow id="f{k}" name="{rnd.choice(["", "yes"])}" sourceRef="n{rnd.randint(0, n)}" targetRef="{rnd.choice("nf")}{rnd.randint(0, n)}"/>' for k in range(2 * n))
        return f"<d><process>{flows[:200] if n == 1 else flows}{nodes}</process></d>"

    found, gold = (spark.createDataFrame([*[(k, diagram(k % 9)) for k in range(start, 40)], (90, None), (91, "<d>"), (92 + start, diagram(8))], "model_id int, xml string") for start in (0, 3))
    keys, scores = ["model_id"], lambda df: sorted((r.model_id, r.n_gold, r.n_found, r.matched, r.score) for r in df.select(*keys, "n_gold", "n_found", "matched", "score").collect())
    f, g = process_graph.diagram_flows(found), process_graph.diagram_flows(gold)
    listed = process_graph.control_flow(documents.bpmn_elements(found), keys).orderBy("model_id", "ord").collect()
    assert [(r.model_id, p.source, p.target) for r in f.orderBy("model_id").collect() for p in r.pairs] == [(r.model_id, r.source, r.target) for r in listed]
    elements = [documents.bpmn_elements(x) for x in (found, gold)]
    assert scores(process_evaluation.control_flow_of_pairs(f, g, keys)) == scores(process_evaluation.control_flow(*elements, keys))
    same = lambda a, b: (a == b).cast("double")
    want = scores(process_evaluation.control_flow(*elements, keys, same))
    monkeypatch.setattr(process_evaluation, "_written", lambda *_: 1 / 0)
    assert scores(process_evaluation.control_flow_of_pairs(f, g, keys, same)) == want


@pytest.mark.parametrize("names", [["unit", "role"], ["role"]])
def test_bindings_of_equal_names_wait_in_queues(spark, names):
    """As many matches as the pairs of bindings give, ties between alike names included."""
    import random

    from clausewright.operators import assign
    from clausewright.plans import evaluation

    rnd = random.Random(3)
    words = ["Head of office", "Head of offices", "Head of Officers", "head of office ", "clerk", "clerks", "Clerk a", "clerk b", "", None, "Board"]
    rows = lambda n: [(k, i, rnd.choice(words), rnd.choice(words)) for k in range(12) for i in range(n)]
    found = spark.createDataFrame([*rows(30), (None, 0, "Board", "Board")], "k int, i int, unit string, role string")
    gold = spark.createDataFrame([*rows(24), (None, 0, "Board", "Board"), (99, 0, "Board", "Board")], "k int, j int, unit string, role string")
    least = evaluation.BINDING_THRESHOLD
    if names == ["role"]:
        pairs = evaluation.name_pairs(found.withColumnRenamed("role", "name"), gold.withColumnRenamed("role", "name"), ["k"], False, least)
    else:
        pairs = evaluation.binding_pairs(found, gold, ["k"])
    want = {r.k: r["count"] for r in assign.greedy(pairs, ["k"], least).groupBy("k").count().collect()}
    assert {r.k: r.tp for r in evaluation.binding_counts(found, gold, ["k"], names).collect()} == want and len(want) == 12
