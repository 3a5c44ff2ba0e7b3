"""Ball k-means: against plain rounds in whole numbers; odd vectors; what the balls spare."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from clausewright.llm import ball_kmeans

ORDER = "sha2(concat('3:', vec_id), 256)"
SCHEMA = "vec_id long, embedding array<double>, ids int, block string, cluster string"


def brute(rows, k, width, scale, rounds):
    kept = []
    for i, v in rows:
        if v is None or len(v) != width or any(x is None or not math.isfinite(x) or abs(math.floor(scale * x)) > 1 << 27 for x in v):
            continue
        kept.append((i, [math.floor(scale * x) for x in v]))
    digest = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centroids)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), shown[j]) for i, j, d in out), key=repr)


def found(spark, rows, k=8, width=4, scale=16.0, rounds=10, parts=3):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in ball_kmeans.cluster(df, "vec_id", "embedding", F.expr(ORDER), k, width, scale, rounds).collect()), key=repr)


def test_equals_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 3 * (i % 5)]) for i in range(400)]
    monkeypatch.setattr(ball_kmeans, "BLOCK", 64)
    assert found(spark, rows) == brute(rows, 8, 4, 16.0, 10)
    assert found(spark, rows, rounds=0) == brute(rows, 8, 4, 16.0, 0)
    assert found(spark, rows, rounds=1, k=3) == brute(rows, 3, 4, 16.0, 1)


def test_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, size=4)]) for i in range(150)] + [(7, [1.0, 0.0, 0.0, 0.0])] * 3 + [(None, [0.0, 0.0, 1.0, 1.0])] * 2
    odd = [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 0.0, 0.0]), (904, [math.nan, 0.0, 0.0, 0.0]), (905, [math.inf, 0.0, 0.0, 0.0]), (906, [1e300, 0.0, 0.0, 0.0])]
    assert found(spark, rows + odd, scale=1.0) == brute(rows + odd, 8, 4, 1.0, 10)
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]
    assert found(spark, same) == brute(same, 8, 4, 16.0, 10)
    assert found(spark, rows[:5]) == brute(rows[:5], 8, 4, 16.0, 10)
    assert found(spark, odd) == [] == found(spark, [])


def test_balls_spare_distances_and_stand_still():
    rng = np.random.default_rng(3)
    centres = rng.integers(-10_000, 10_000, (20, 16))
    x = np.repeat(centres, 500, axis=0) + rng.integers(-300, 300, (10_000, 16))
    labels = np.repeat(np.arange(20), 500).astype(np.int32)
    radii = [ball_kmeans._root(int(ball_kmeans.squared(x[labels == j], c).max())) for j, c in enumerate(centres)]
    balls = ball_kmeans.Balls.around(centres, radii, [True] * 20)
    new, far, _, done = balls.assign(x, labels)
    exact = np.stack([ball_kmeans.squared(x, c) for c in centres])
    assert (new == exact.argmin(axis=0)).all() and (far == exact.min(axis=0)).all()
    assert done < 1.2 * len(x)  # not 20 a vector
    still = ball_kmeans.Balls.around(centres, radii, [j == 0 for j in range(20)])
    assert sum(still.still) >= 15 and still.assign(x, labels)[3] < 5 * 500


def test_only_labels_move(spark, tmp_path):
    """The blocks are joined where they lie: the only shuffle of a round is that of the labels."""
    rows = spark.range(1000).select(F.col("id").alias("block"), F.lit(b"abcd").alias("body"))
    rows.repartition(4, "block").write.bucketBy(4, "block").format("parquet").option("path", f"{tmp_path}/blocks").saveAsTable("test_ball_blocks")
    labels = spark.range(1000).select(F.col("id").alias("block"), F.lit(b"x").alias("labels"))
    plan = spark.table("test_ball_blocks").join(labels.hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table test_ball_blocks")
    assert plan.count("Exchange") == 1 and "ShuffledHashJoin" in plan
