"""The arc parser on hand-parsed sentences, and the dynamic programme against every projective tree."""

import itertools

import numpy as np
import pytest

from clausewright.functions import arcs
from clausewright.operators import grammar

#: Sentence | arcs (label:word>head) that a reader gives it; words are told apart by their first occurrence.
HAND = """
The provider shall notify the competent authority. | nsubj:provider>notify dobj:authority>notify aux:shall>notify amod:competent>authority
The Commission shall ensure that providers comply with the rules. | nsubj:Commission>ensure ccomp:comply>ensure mark:that>comply nsubj:providers>comply pobj:rules>with
The Board, which shall meet twice a year, must act. | nsubj:Board>act relcl:meet>Board nsubj:which>meet
The file shall be kept by the Commission. | nsubjpass:file>kept agent:by>kept pobj:Commission>by auxpass:be>kept
If the importer objects, the Commission may refer to Annex IV. | advcl:objects>refer mark:If>objects nsubj:importer>objects nsubj:Commission>refer pobj:Annex>to
The Commission and the Council shall assess and approve the report. | nsubj:Commission>assess conj:Council>Commission cc:and>Commission conj:approve>assess dobj:report>approve
Member States shall require operators to submit a report. | nsubj:States>require xcomp:submit>require dobj:report>submit aux:to>submit
The report which the Board adopted shall be published. | nsubjpass:report>published relcl:adopted>report nsubj:Board>adopted
The authority shall inform the provider that the file is complete. | dobj:provider>inform ccomp:is>inform nsubj:file>is
The operator must not market the product. | neg:not>market dobj:product>market nsubj:operator>market
Where the authority refuses the application, it shall inform the applicant. | advcl:refuses>inform nsubj:authority>refuses nsubj:it>inform dobj:applicant>inform
The Board shall adopt its decision within two months. | dobj:decision>adopt prep:within>adopt pobj:months>within
The controller shall keep a record of all processing activities. | dobj:record>keep prep:of>record pobj:activities>of
The measures adopted by the Member State shall apply. | nsubj:measures>apply acl:adopted>measures prep:by>adopted pobj:State>by
The importer, the provider and the operator shall cooperate. | nsubj:importer>cooperate conj:provider>importer conj:operator>provider
The Agency may request information from the manufacturer. | nsubj:Agency>request dobj:information>request pobj:manufacturer>from
The data shall be erased without undue delay. | nsubjpass:data>erased pobj:delay>without
Operators that process personal data shall appoint an officer. | nsubj:Operators>appoint relcl:process>Operators nsubj:that>process dobj:data>process dobj:officer>appoint
The Commission shall verify that the file is complete. | ccomp:is>verify nsubj:file>is
The Council may decide to suspend the procedure. | xcomp:suspend>decide dobj:procedure>suspend
The authority shall not disclose the report unless the applicant agrees. | neg:not>disclose dobj:report>disclose nsubj:applicant>agrees
Providers shall establish and maintain a register. | nsubj:Providers>establish conj:maintain>establish dobj:register>maintain
The certificate shall be issued by the Board and published by the Agency. | nsubjpass:certificate>issued agent:by>issued pobj:Board>by conj:published>issued
The Commission is required to consult the Board. | xcomp:consult>required dobj:Board>consult nsubjpass:Commission>required
When the period ends, the operator must file a report. | advcl:ends>file nsubj:period>ends nsubj:operator>file
The user shall be able to delete the data. | nsubj:user>be dobj:data>delete
The auditor shall examine whether the system is compliant. | ccomp:is>examine mark:whether>is nsubj:system>is
A person who holds a licence may operate the vehicle. | nsubj:person>operate relcl:holds>person nsubj:who>holds dobj:licence>holds dobj:vehicle>operate
The notification shall include the name and the address of the holder. | dobj:name>include conj:address>name prep:of>address pobj:holder>of
The competent authority shall promptly inform the Commission thereof. | advmod:promptly>inform nsubj:authority>inform dobj:Commission>inform
The Member State concerned shall notify the measure to the Commission. | dobj:measure>notify nsubj:State>notify acl:concerned>State
The holder may object and the Board shall decide. | nsubj:holder>object nsubj:Board>decide conj:decide>object
The Council shall approve or reject the proposal. | conj:reject>approve cc:or>approve dobj:proposal>reject
The supervisor has verified the documents. | nsubj:supervisor>verified aux:has>verified dobj:documents>verified
The inspection was carried out by the competent authority. | nsubjpass:inspection>carried agent:by>carried pobj:authority>by
For each incident, the operator shall submit a notification. | pobj:incident>For nsubj:operator>submit dobj:notification>submit
The entity shall provide the authority with a report. | nsubj:entity>provide pobj:report>with
The report shall describe the impact of the incident and the measures taken. | dobj:impact>describe pobj:incident>of acl:taken>measures
The applicant may appeal against the decision of the Agency. | nsubj:applicant>appeal pobj:decision>against prep:of>decision pobj:Agency>of
The Commission shall request that the Board give an opinion. | ccomp:give>request nsubj:Board>give dobj:opinion>give
The body shall ensure that the data that it collects are accurate. | ccomp:are>ensure nsubj:data>are relcl:collects>data nsubj:it>collects
The system must allow users to object. | nsubj:system>allow xcomp:object>allow
No provider may refuse access. | det:No>provider nsubj:provider>refuse dobj:access>refuse
They shall submit the plan before the deadline. | nsubj:They>submit dobj:plan>submit pobj:deadline>before
The Agency should review the guidelines and update the list. | dobj:guidelines>review conj:update>review dobj:list>update
The Commission shall inform the Council and the Parliament. | dobj:Council>inform conj:Parliament>Council cc:and>Council
Annex II shall contain the list of authorities. | nsubj:Annex>contain nummod:II>Annex dobj:list>contain pobj:authorities>of
A decision taken under Article 5 shall be notified to the parties. | nsubjpass:decision>notified acl:taken>decision pobj:Article>under nummod:5>Article
The operator shall demonstrate that it has fulfilled the requirements. | ccomp:fulfilled>demonstrate nsubj:it>fulfilled dobj:requirements>fulfilled
Once the Board has decided, the applicant must comply. | advcl:decided>comply nsubj:Board>decided nsubj:applicant>comply
The manager shall appoint a person to supervise the work. | dobj:person>appoint nsubj:manager>appoint dobj:work>supervise
The notified body shall assess the file and inform the manufacturer. | amod:notified>body nsubj:body>assess dobj:file>assess conj:inform>assess dobj:manufacturer>inform
The Commission, after consulting the Board, shall adopt the act. | nsubj:Commission>adopt dobj:act>adopt dobj:Board>consulting
The Member States shall lay down the rules on penalties. | nsubj:States>lay dobj:rules>lay pobj:penalties>on
The requirement shall not apply to small enterprises. | neg:not>apply pobj:enterprises>to nsubj:requirement>apply
The processor shall delete all copies if the controller so requests. | dobj:copies>delete advcl:requests>delete mark:if>requests
The officers and inspectors of the Agency may enter the premises. | nsubj:officers>enter conj:inspectors>officers pobj:Agency>of dobj:premises>enter
The group which represents consumers shall give an opinion. | nsubj:group>give relcl:represents>group nsubj:which>represents dobj:opinion>give
The Parliament was informed that the measure had lapsed. | ccomp:lapsed>informed nsubj:measure>lapsed nsubjpass:Parliament>informed
The court may order the provider to remove the content. | dobj:provider>order xcomp:remove>order dobj:content>remove
The Commission shall be assisted by a committee. | agent:by>assisted pobj:committee>by nsubjpass:Commission>assisted
The exporter must keep the licence and show it to the officer. | dobj:licence>keep conj:show>keep dobj:it>show pobj:officer>to
"""
HAND = [line.split(" | ") for line in HAND.strip().splitlines()]


def arcs_of(words):
    return {f"{w['dep']}:{w['text']}>{words[w['head']]['text'] if w['head'] >= 0 else ''}" for w in words}


def test_hand_parsed_sentences():
    assert len(HAND) >= 60
    found = arcs.parse([s for s, _ in HAND])
    wrong = {s: missing for (s, want), words in zip(HAND, found) if (missing := set(want.split()) - arcs_of(words))}
    total = sum(len(want.split()) for _, want in HAND)
    assert sum(map(len, wrong.values())) <= 0.03 * total, wrong


def trees(n):
    """Every projective tree over places 1 .. n - 1 under root 0, as tuples of heads."""
    for heads in itertools.product(range(n), repeat=n - 1):
        full = (-1, *heads)
        if any(h == i for i, h in enumerate(full)):
            continue
        reach = lambda i: i == 0 or reach(full[i])
        seen_ok = True
        for i in range(1, n):
            at, steps = i, 0
            while at and steps <= n:
                at, steps = full[at], steps + 1
            seen_ok &= at == 0
        spans = [(min(i, full[i]), max(i, full[i])) for i in range(1, n)]
        if seen_ok and not any(a < c < b < d for a, b in spans for c, d in spans):
            yield full


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_best_tree_of_all(n):
    rng = np.random.default_rng(n)
    s = rng.normal(size=(30, n, n)).astype(np.float32)
    s[:, :, 0] = -1e4
    s[:, np.arange(n), np.arange(n)] = -1e4
    every = list(trees(n))
    for x, heads in enumerate(arcs.eisner(s)):
        best = max(every, key=lambda t: sum(s[x, t[i], i] for i in range(1, n)))
        assert tuple(heads) == best


def test_odd_texts(spark):
    long = "The provider shall notify the authority, and " * 300 + "stop."
    texts = [None, "", "  ", ".", "Ä", "word", "# $ %", long, "of of of", "shall", "that", "to to to", "x" * 5000]
    found = arcs.parse(texts)
    for text, words in zip(texts, found):
        assert [w["i"] for w in words] == list(range(len(words)))
        assert all(text[w["start"] : w["end"]] == w["text"] for w in words)
        assert all(w["head"] != w["i"] and -1 <= w["head"] < len(words) and w["dep"] for w in words)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, words string")
    got = grammar.parsed(rows.drop("words"), "t").collect()
    assert {r.i: [w.asDict() for w in r.words] for r in got} == dict(enumerate(found))
    assert grammar.parsed(rows.drop("words").limit(0), "t").count() == 0
    assert grammar.modal_tasks(rows, "t", "done").select("i", "t", "words").orderBy("i").collect() == rows.orderBy("i").collect()


def test_tasks_of_modals(spark):
    said = {
        "The Commission shall ensure that providers comply with the rules.": [("ensure that comply with the rules", "shall", "own", ["Commission"], []), ("that comply with the rules", "shall", "handed", ["providers"], [])],
        "If the importer objects, the Board and the Council may not assess or approve the plan.": [("assess", "may not", "own", ["Board"], ["If the importer objects"]), ("approve the plan", "may not", "joined", ["Board"], ["If the importer objects"])],
        "The authority may request the operator to file a plan.": [("request the operator file a plan", "may", "own", ["authority"], []), ("file a plan", "shall", "requested", ["authority"], ["if requested"])],
        "Operators are required to keep a record.": [("keep a record", "is required to", "own", ["Operators"], [])],
        "The report shall be published by the Agency.": [("published by the Agency", "shall", "own", ["Agency"], [])],
        "It must vote.": [("vote", "must", "own", [], [])],
        "No modal here.": [],
    }
    rows = spark.createDataFrame([(s,) for s in [*said, None, ""]], "t string")
    got = {r.t: [(x.label, x.modality, x.kind, x.subjects, x.conditions) for x in r.tasks] for r in grammar.modal_tasks(rows, "t").collect()}
    assert got == {**said, None: [], "": []}
