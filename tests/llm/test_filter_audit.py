"""Filter audit: against one pass over the rows an order; odd rows; copies above and below the share that is broadcast."""

import re
from itertools import permutations

import pytest

from clausewright.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, fails int, digest string"


def brute(rows, labels):
    least, bits = {}, []
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, s in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        bits.append((s or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, {}
    for part in {b[0] for b in bits}:
        here = [b[1:] for b in bits if b[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                lost = [b for b in left if b[0][f]]
                left = [b for b in left if not b[0][f]]
                failing = [b for b in here if b[0][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(lost)
                out[part, order, step] = (len(left), len(lost), len(failing) - len(lost), sum(sum(b[0].values()) == 1 for b in failing), sum(b[1] for b in lost), sum(b[2] for b in lost))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, rows, labels, share=filter_audit.HOT_SHARE):
    docs = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA).repartition(3)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit._orders(filter_audit.prefix_counts(filter_audit.bitmap_index(docs, given, share)))
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}


def sample():
    long = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", long, long + " A", "same " * 70, "ONE TWO " * 40, long + " #", "ä$ " + long, "ÄRGER", long.upper(), "x\x0b\x0cy", "a b c " * 60, "tag & |"]
    rows = [(i, texts[i * i % len(texts)], [None, "", "web", "book"][i % 4]) for i in range(90)]
    rows += [(200, long, "web"), (200, long, "web"), (None, long, "web"), (None, None, None), (3, "other", "book")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 90, 2)] + [(2, 1, 0), (2, 0, None), (None, 1, 1), (500, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("share", [filter_audit.HOT_SHARE, 10, 1])
def test_equals_plain_orders(spark, share):
    rows, labels = sample()
    assert found(spark, rows, labels, share) == brute(rows, labels)


def test_a_text_and_a_part_that_most_rows_share(spark):
    rows = [(i, "copy", "hot" if i % 10 else f"p{i}") for i in range(700)]
    assert found(spark, rows, [(5, 1, 1)], 50) == brute(rows, [(5, 1, 1)])


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    rows, _ = sample()
    assert found(spark, rows, []) == brute(rows, [])
    assert found(spark, [(None, None, None)], []) == brute([(None, None, None)], [])
