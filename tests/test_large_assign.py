"""Assignment in rounds: the matches of the streamed kernels."""

import random

import pytest
from pyspark.sql import functions as F

from clausewright.operators import assign, large_assign, vectors

SCHEMA = "k int, i int, j int, score double"


def pairs(spark, seed, n_i=40, n_j=40, share=0.3, grades=12):
    rnd = random.Random(seed)
    rows = [(k, i, j, rnd.randint(0, grades) / grades) for k in (0, 1, None) for i in range(n_i) for j in range(n_j) if rnd.random() < share]
    return spark.createDataFrame(rows + rows[:7], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.select("k", "i", "j", "score").collect()), key=repr)


@pytest.mark.parametrize("method", ["greedy", "gold_order"])
@pytest.mark.parametrize("seed, share", [(1, 0.3), (2, 1.0), (3, 0.05)])
def test_equals_streamed(spark, method, seed, share):
    df = pairs(spark, seed, share=share)
    assert rows(getattr(large_assign, method)(df, ["k"], 0.25, streamed=0)) == rows(getattr(assign, method)(df.distinct(), ["k"], 0.25))


def test_groups_of_both_kinds(spark):
    df = pairs(spark, 4).union(spark.createDataFrame([(7, 1, 1, 0.9), (7, 1, 2, 0.8), (7, 2, 1, 0.85)], SCHEMA))
    assert rows(large_assign.greedy(df, ["k"], 0.5, streamed=100)) == rows(assign.greedy(df.distinct(), ["k"], 0.5))
    assert large_assign.greedy(df.limit(0), ["k"], 0.5).count() == 0


def test_optimal_by_parts(spark):
    rnd = random.Random(5)
    rows_ = [(0, 10 * c + a, 10 * c + b, rnd.random()) for c in range(12) for a in range(5) for b in range(4) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows_, SCHEMA)
    assert rows(large_assign.optimal(df, ["k"], 0.3, streamed=0)) == rows(assign.optimal(df, ["k"], 0.3))


def test_long_chain(spark):
    """Each candidate is better than the one before: rounds go down the chain and end."""
    chain = [(0, n // 2 + n % 2, n // 2, 0.5 + n / 1000) for n in range(60)]
    df = spark.createDataFrame(chain, SCHEMA)
    assert rows(large_assign.greedy(df, ["k"], 0.0, streamed=0)) == rows(assign.greedy(df, ["k"], 0.0))


@pytest.mark.parametrize("n_i, n_j", [(9, 9), (5, 12), (12, 5), (1, 7), (0, 4)])
def test_optimal_on_line(spark, n_i, n_j):
    """The total of the whole rectangle, whichever side is larger; the pairs too, since their numbers differ."""
    rnd = random.Random(10 * n_i + n_j)
    found = [(k, i, x) for k in range(3) for i, x in enumerate(rnd.sample(range(1000), n_i))]
    gold = [(k, j, y) for k in range(3) for j, y in enumerate(rnd.sample(range(1000), n_j))]
    left, right = spark.createDataFrame([*found, (None, 1, 1), (1, 99, None)], "k int, i int, x long"), spark.createDataFrame([*gold, (None, 2, 1), (8, 0, 5)], "k int, j int, y long")
    got = rows(large_assign.optimal_on_line(left, right, ["k"], 1e6, 1e6 - 40_000))
    every = spark.createDataFrame([(k, i, j, 1e6 - (x - y) ** 2) for k, i, x in found for h, j, y in gold if h == k], SCHEMA)
    want = rows(assign.optimal(every, ["k"], 1e6 - 40_000))
    assert sum(r[3] for r in got) == sum(r[3] for r in want) and len(got) == len(want)


def test_optimal_on_line_lists_no_pairs(spark):
    """60,000 items in one group: its pairs would be 3.6 billion."""
    side = spark.range(60_000)
    found, gold = side.select(F.lit(1).alias("k"), F.col("id").alias("i"), (3 * F.col("id")).alias("x")), side.select(F.lit(1).alias("k"), F.col("id").alias("j"), (2 * F.col("id") + 7).alias("y"))
    assert sorted(r[1:3] for r in rows(large_assign.optimal_on_line(found, gold, ["k"], 1e12, 1e12 - 2500))) == [(n, n) for n in range(58)]


def vectors_of(spark, seed, repeated):
    rnd = random.Random(seed)
    side = lambda n: [(k, m, [float(rnd.randint(-2, 3)) for _ in range(3 + k % 2)]) for k in range(3) for m in range(n)]
    odd = [(None, 1, [1.0] * 3), (1, None, [1.0] * 3), (1, 500, [1.0, None, 2.0]), (1, 501, []), (1, 502, [float("nan")] * 4), (0, 503, [9.0] * 5)]
    found, gold = side(30) + odd + repeated, side(25) + odd[:2]
    return spark.createDataFrame(found, "k int, i int, v array<double>"), spark.createDataFrame(gold, "k int, j int, v array<double>")


@pytest.mark.parametrize("products, repeated", [(10_000, []), (10_000, [(2, 4, [3.0, 3.0, 3.0])]), (0, [])])
def test_gold_order_of_vectors(spark, monkeypatch, products, repeated):
    monkeypatch.setattr(large_assign, "HELD", 64)
    found, gold = vectors_of(spark, 6, repeated)
    want = rows(large_assign.gold_order(vectors.product_pairs(found, gold, "k", 2.0), ["k"], 2.0))
    assert rows(large_assign.gold_order_of_vectors(found, gold, "k", 2.0, products)) == want and len(want) > 40


def test_gold_order_of_vectors_writes_no_candidates(spark, monkeypatch):
    found, gold = vectors_of(spark, 7, [])
    monkeypatch.setattr(vectors, "product_pairs", lambda *_: pytest.fail("candidates were listed"))
    assert large_assign.gold_order_of_vectors(found, gold, "k", 2.0).count() > 40
