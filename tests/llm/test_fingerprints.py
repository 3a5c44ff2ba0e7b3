"""Piecewise hashes against a plain version: one byte at a time, chunk by chunk, edit distance by the table."""

import hashlib
import random

import pytest

from clausewright.llm import ctph

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_fingerprint(data):
    if not data:
        return "3::"
    rolled = []
    for i in range(len(data)):
        v = sum((data[i - back] + 1) * pow(0x01000193, back, 1 << 32) for back in range(min(7, i + 1))) & M32
        v = (v ^ v >> 15) * 0x2C1B3C6D & M32
        rolled.append(v ^ v >> 12)

    def signature(block):
        out, total, fresh = "", 0, False
        for v in rolled:
            total, fresh = (total + mixed(v + 1)) & M64, True
            if v % block == block - 1 and len(out) < 63:
                out, total, fresh = out + LETTERS[mixed(total) >> 58], 0, False
        return out + LETTERS[mixed(total) >> 58] if fresh else out

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(signature(block)) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def distance(a, b):
    """Insertions and removals."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def plain_likeness(f, g):
    if f == g:
        return 1.0
    (p, a, aa), (q, b, bb) = f.split(":"), g.split(":")
    of_f, of_g = {int(p): a, 2 * int(p): aa}, {int(q): b, 2 * int(q): bb}
    scores = [1 - distance(of_f[k], of_g[k]) / (len(of_f[k]) + len(of_g[k])) for k in of_f.keys() & of_g.keys() if of_f[k] or of_g[k]]
    return max(scores, default=0.0)


def texts():
    rnd = random.Random(21)
    make = lambda n: "".join(rnd.choice("abc dé日 🙂\n") for _ in range(n))
    base = make(900)
    out = ["", "a", "ab" * 40, make(5), make(63), make(700), make(6000), base, base[:400] + "xyz" + base[400:], base[50:], "\0" * 300, "a" * 5000]
    return out + [make(rnd.randint(1, 400)) for _ in range(20)]


def test_fingerprints_equal_plain_ones():
    made = [ctph.fingerprint(t.encode()) for t in texts()]
    assert made == [plain_fingerprint(t.encode()) for t in texts()]
    pairs = [(f, g) for f in made for g in made]
    got = ctph.likeness([f for f, _ in pairs], [g for _, g in pairs])
    assert all(abs(x - plain_likeness(f, g)) < 1e-12 for x, (f, g) in zip(got, pairs))


def test_an_edit_keeps_most_of_a_fingerprint():
    near = ctph.likeness([ctph.fingerprint(texts()[7].encode())], [ctph.fingerprint(texts()[8].encode())])[0]
    assert near > 0.8


@pytest.mark.parametrize("parts", [1, 7])
def test_each_document_meets_its_next(spark, parts):
    many = texts()
    rows = [(i, t or None, "clash") for i, t in enumerate(many)] + [(None, t, "clash") for t in many[5:9]] + [(3, many[6], "clash"), (3, many[3], "clash"), (12, many[12], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(parts)
    got = sorted((tuple(r) for r in ctph.fingerprints(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[3], r[2]))
    line = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(line):
        following = line[(k + 1) % len(line)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        f, g, h = (plain_fingerprint(x.encode()) for x in (t, changed, following))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), f, g, plain_likeness(f, g), plain_likeness(f, h)))
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[3], r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(x - y) < 1e-12 for g, w in zip(got, want) for x, y in zip(g[5:], w[5:]))


def test_one_id_of_very_many_rows_spreads(spark):
    """A third of all rows share one doc_id: no range gets them all."""
    docs = spark.createDataFrame([(5 if i % 3 == 0 else i, f"text {i} of many") for i in range(3000)], "doc_id long, text string")
    key = ctph.F.col("doc_id").asc_nulls_first()
    sizes = docs.repartitionByRange(12, key, ctph.F.substring("text", 1, ctph._DEALT_BY)).groupBy(ctph.F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 600
    assert ctph.fingerprints(docs).count() == 3000
