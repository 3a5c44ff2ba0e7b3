"""References as spans: the token rules on literals, and against a plain reading of each text."""

import random

import pytest
from pyspark.sql import functions as F

from clausewright.functions.rewriting import REFERENCE_MARKERS
from clausewright.operators import references

CASES = {
    "in accordance with regulation (EU) 2016/679": ["regulation (EU) 2016/679"],
    "see Regulation (EU) No. 12/2020, Directive 95/46/EC": ["Regulation (EU) No. 12/2020"],
    "Implementing Regulation (EC) 2009/136/EC": ["Implementing Regulation (EC) 2009/136", "Implementing Regulation (EC) 2009/136/EC", "Regulation (EC) 2009/136", "Regulation (EC) 2009/136/EC"],
    "Regulation (eu) 1/2020, Decision (Euratom) no 7/2001": ["Decision (Euratom) no 7/2001"],
    "under section dealing with point declared": [],
    "under Section D and point IV": ["Section D"],
    "under the point IV of it": ["point IV"],
    "pursuant to Article 5(2)": ["Article 5", "Article 5(2)"],
    "pursuant to Article 5, paragraph 2 and Annex IV, point 3": ["Article 5", "Article 5, paragraph 2"],
    "as referred to in Article 5 or Article 7": ["Article 5", "Article 7"],
    "laid down in Art. 3 and by virtue of ART.  IV": ["ART. IV", "Art. 3"],
    "under " + "x" * 53 + " Articles 5 and 6(1)": ["Article 5", "Article 6(1)"],
    "under " + "x" * 54 + " Articles 5 and 6(1)": [],
    "Articles 5 and 6 under it": [],
    "misunderstanding Articles 3": ["Article 3"],
    "according to  paragraph\n 4": ["paragraph 4"],
    "": [],
}


def rows_of(spark, texts, existing=None):
    rows = [(i, t, existing or [], "x", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id int, t string, existing array<string>, kind string, start int")


def test_literals(spark):
    texts = [*CASES, None]
    got = references.reference_rows(rows_of(spark, texts), ["doc_id"], "t", "existing").groupBy("doc_id").agg(F.array_sort(F.collect_set("reference")).alias("r")).collect()
    found = {r.doc_id: r.r for r in got}
    assert {t: found.get(i, []) for i, t in enumerate(texts)} == {**CASES, None: []}


def test_own_articles_are_not_external(spark):
    rows = rows_of(spark, ["under Articles 5, 6 and 8, pursuant to Article 6 and Annex II"], ["6", "8"])
    got = {(r.reference, r.external) for r in references.reference_rows(rows, ["doc_id"], "t", "existing").collect()}
    assert got == {("Article 5", True), ("Article 6", False)}


def plain(text):
    """Every pair of spans looked at."""
    found = references.spans_of(text or "")
    marks = [s for s in found if s["kind"] == "marker"]
    out = set()
    for s in found:
        near = any(m["last"] in (s["first"], s["first"] - 1) for m in marks)
        ahead = (text or "")[max(0, s["start"] - 60) : s["start"]].lower()
        if s["kind"] == "citation" or s["kind"] == "internal" and near or s["kind"] == "articles" and any(m.lower() in ahead for m in REFERENCE_MARKERS):
            out.add((s["kind"], s["start"], s["end"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_pair(spark, seed):
    rnd = random.Random(seed)
    bits = [*REFERENCE_MARKERS, "Article 5", "Articles 5, 6 and 8(2)", "article 7(1)", "Art. 3", "Annex IV, point 2", "annex iv", "Regulation (EU) 1/2020", "the", "and", ",", ".", "(2)", "x" * 30, "İ", "paragraph 3"]
    texts = [" ".join(rnd.choices(bits, k=rnd.randint(1, 12))) for _ in range(300)] + ["".join(rnd.choices(bits, k=3000))]
    rows = rows_of(spark, texts + texts[:20]).withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7))  # keys repeat and are null
    got = references.marked(rows, ["doc_id"], "t").join(rows.select(F.xxhash64("t").alias("text_hash"), "t").distinct(), "text_hash").collect()
    found = {}
    for r in got:
        found.setdefault(r.t, set()).add((r.kind, r.start, r.end))
    assert {t: found.get(t, set()) for t in texts} == {t: plain(t) for t in texts}
