"""Top-k search: odd vectors, repeats, large values, and what the bounds save, against brute force."""

import numpy as np

from clausewright.llm import topk


def brute(rows, is_query, k, scale):
    """rows: (id, components); scores as whole numbers, ends at 64 bits."""
    width = max((len(v) for _, v in rows), default=0)
    whole = [(i, [min(max(int(np.floor(scale * x)), -(2**63)), 2**63) for x in v] + [0] * (width - len(v))) for i, v in rows]
    out = []
    for q, v in sorted({i: v for i, v in sorted(whole, key=lambda r: r[1], reverse=True) if is_query(i)}.items()):
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in whole if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def found(spark, rows, k, scale, where="vec_id % 5 = 0", parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    return [tuple(r) for r in topk.top_k(df.where(where), df, "vec_id", "embedding", k, scale).orderBy("query_id", "rank").collect()]


def test_shorter_empty_and_repeated(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=1 + i % 7)]) for i in range(60)] + [(61, []), (65, []), (7, [1.0, 2.0]), (7, [3.0, -2.0])]
    assert found(spark, rows, 5, 16.0) == brute(rows, lambda i: i % 5 == 0, 5, 16.0)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0, 2.0]), (5, [2.0, 1.0]), (6, [0.0, 0.0])]
    assert found(spark, rows, 5, 1.0) == brute(rows, lambda i: i % 5 == 0, 5, 1.0)


def test_large_values(spark):
    rows = [(i, [float((-1) ** i * 2.0 ** (20 + i)), float(i), 2.0**31]) for i in range(40)] + [(100, [1e300, -1e300, 0.0]), (101, [2.0**62, 2.0**62, 1.0])]
    assert found(spark, rows, 3, 1.0) == brute(rows, lambda i: i % 5 == 0, 3, 1.0)


def test_a_vector_that_a_third_of_all_rows_share(spark):
    rng = np.random.default_rng(4)
    common = [float(x) for x in rng.normal(size=8)]
    rows = [(i, common if i % 3 == 0 else [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    assert found(spark, rows, 5, 256.0) == brute(rows, lambda i: i % 5 == 0, 5, 256.0)


def test_bounds_spare_exact_scores_of_smooth_vectors():
    """Vectors that are level inside segments, as the bounds suit: few pairs need their exact score, none is lost."""
    rng = np.random.default_rng(5)
    x = np.floor(np.repeat(rng.normal(size=(20_000, 16)) * rng.gamma(1.0, 60.0, (20_000, 1)), 4, axis=1) + rng.normal(size=(20_000, 64)) * 0.5)
    ids = rng.permutation(20_000)
    q, cell = topk.Vectors(ids[:200], x[:200]), topk.Vectors(ids, x).chunks()
    best = topk.Best(200, 5)
    exact = sum(topk.look_through(q, chunk, best) for chunk in cell)
    assert exact < 0.1 * 200 * 20_000
    scores = (x[:200] @ x.T).astype(np.int64)
    for r in range(200):
        want = sorted((-scores[r, j], ids[j]) for j in range(20_000) if ids[j] != ids[r])[:5]
        assert [(-s, i) for s, i in zip(best.scores[best.row == r], best.ids[best.row == r])] == want
