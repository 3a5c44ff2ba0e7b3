"""Substring and near dedup on hot groups, odd rows and clashing names, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from clausewright.llm import minhash, substring_dedup
from clausewright.llm.queries import op6_near_dedup


def brute_removed(texts, width):
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((len(w), len(gone)))
    return out


def passages():
    rnd = random.Random(31)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    hot, warm = make(70), make(45)
    out = [make(rnd.randint(0, 120)) + " " + hot + " " + make(rnd.randint(0, 20)) for _ in range(40)]
    out += [make(15) + " " + warm + " " + hot[: len(hot) // 2] for _ in range(10)] + [hot + " " + hot, "z " * 200, "z " * 90]
    return out + [make(100) for _ in range(20)] + [None, "", "one", make(34), make(35)]


@pytest.mark.parametrize("part", [50, 1000, 1 << 22])
def test_buckets_in_parts(spark, monkeypatch, part):
    """Buckets that are worked off in small parts find the same spans: this runs the steps in this process."""
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "_PART", part)
    monkeypatch.setattr(substring_dedup, "_SCAN", 2000)
    texts = passages()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], ["_key", "_mark", "text"])
    rows = [r for b in substring_dedup._scan(35, 3)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
    rows.sort(key=lambda r: r[0])
    types = (pa.int32(), *[pa.binary()] * 6)
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 7]), types)], substring_dedup._FIELDS) for k in range(0, len(rows), 7)]
    gone = [set() for _ in texts]
    for b in substring_dedup._compact(35)(iter(batches)):
        for key, _, low, high in zip(*(c.to_pylist() for c in b.columns)):
            gone[key].update(range(low, high))
    assert [len(g) for g in gone] == [n for _, n in brute_removed(texts, 35)]


def test_equal_hashes_of_other_edges():
    """Two windows that only share their window hash are not taken for one edge."""
    held = substring_dedup.Bucket()
    columns = lambda key, least: [np.array(x, t).tobytes() for x, t in zip(([key], [0], [0], [1], [least], [77]), substring_dedup._TYPES)]
    held.add(columns(1, 5)), held.add(columns(2, 6))
    assert held.work_off() is None
    held.add(columns(3, 6))
    keys, _, starts, lengths = held.work_off()
    assert sorted(keys.tolist()) == [2, 3] and starts.tolist() == [0, 0] and lengths.tolist() == [1, 1]


def test_many_equal_rows_and_clashing_names(spark):
    texts = passages()[:3]
    rows = [(1, texts[0], "a", "b", 5.0)] * 2000 + [(2, texts[1], "c", "d", 6.0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, `_key` string, `_spans` double").repartition(5)
    got = substring_dedup.remove_repeated(docs, 35, keep_columns=True)
    assert got.columns == docs.columns
    found = got.collect()
    assert len(found) == 2002 and sum(r.text == "" for r in found) == 2000 and all((r.row, r["_key"], r["_spans"]) == ("a", "b", 5.0) for r in found if r.doc_id == 1)


def near(rnd, words, n, change):
    base = [rnd.choice(words) for _ in range(n)]
    other = list(base)
    for k in change:
        other[k] = "changed%d" % k
    return " ".join(base), " ".join(other)


def test_no_link_near_the_threshold_is_lost(spark, tmp_path):
    """Pairs whose sets share from 85 % on: every one of them is linked, and none below."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows, want = [], {}
    for k in range(600):
        n = rnd.randint(60, 130)
        a, b = near(rnd, words, n, rnd.sample(range(3, n - 3, 4), rnd.randint(1, 4)))
        sets = [{tuple(t.split()[i : i + 3]) for i in range(n - 2)} for t in (a, b)]
        rows += [(2 * k, a), (2 * k + 1, b)]
        want[k] = 100 * len(sets[0] & sets[1]) >= 85 * len(sets[0] | sets[1])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.component_id for r in op6_near_dedup(spark, str(tmp_path)).collect()}
    assert {k: got[2 * k + 1] == 2 * k for k in want} == want and 100 < sum(want.values()) < 500


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    a, b = near(rnd, words, 200, [40])
    c, d = near(rnd, words, 200, [50])
    rows = [(None, a, 1), (None, b, 2), (7, c, 3), (3, d, 4), (7, c, 5), (7, c, 3), (None, None, 6), (None, None, 6), (9, "", 7), (None, "  ", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_row` int").repartition(4)
    got = minhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert [r["_row"] for r in found if r.text == d] == [4] and not [r for r in found if r.text == c]
    assert len([r for r in found if r.text in (a, b)]) == 1
    assert sorted(r["_row"] for r in found if not (r.text or "").strip()) == [6, 7, 8]


def thue_morse(n, zero="a", one="b"):
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


def test_words_and_passages_that_a_polynomial_takes_for_equal(spark, tmp_path):
    """Thue-Morse words and their mirror images are equal under any polynomial modulo 2^64 with an odd base."""
    one, other = "".join(thue_morse(1024)), "".join(thue_morse(1024, "b", "a"))
    head = [f"w{i}" for i in range(34)]
    texts = [one, other, " ".join([*head, one]), " ".join([*head, other]), " ".join(thue_morse(2048)), " ".join(thue_morse(2048, "b", "a"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = lambda width: {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated(docs, width).collect()}
    assert [removed(35)[i] for i in (0, 1, 2, 3)] == [0, 0, 0, 0]
    for width in (35, 1025):
        assert [removed(width)[i] for i in range(6)] == [n for _, n in brute_removed(texts, width)]
    docs.where("doc_id < 4").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.component_id for r in op6_near_dedup(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 2, 3: 2}


def test_clusters_dealt_by_their_shingles(spark, tmp_path, monkeypatch):
    """Many blocks of few shingles give the links of one."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    base = [rnd.choice(words) for _ in range(300)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rnd.sample(range(3, 297), 40))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(minhash, "SHINGLE_BLOCK", 1000)
    assert {r.component_id for r in op6_near_dedup(spark, str(tmp_path)).collect()} == {0}
