"""Ball k-means over integer vectors: exact assignments with few distances.

A cluster is a ball: its centroid, and a radius that no member lies beyond.  With squared distances as whole numbers, a member of ball i
can be as near to centroid j only if 4 * d(x, ci) >= D(ci, cj); so

* j is a neighbour of ball i only if 4 * radius >= D(ci, cj): other centroids are never looked at for its members;
* the stable core of the ball (4 * d < the least D) stays without a comparison;
* what is left lies in annuli, one for each neighbour in order of D: a member in the s-th is compared with the s nearest
  neighbours, exactly, ties to the smaller number.

A ball whose centroid and neighbours stood still keeps its members without any distance.  The radius after a move is the old one, or the
largest distance just found, plus the length of the move, rounded up.

On Spark: a scan packs vectors into blocks, which are written once, as a table bucketed by block.  A round joins the last labels (four
bytes a vector, the only thing that moves) to the blocks where they lie, and writes new labels with what each block adds to the sums of
its balls: only vectors that change their ball are added up.  Those sums are aggregated by ball; the driver holds k centroids, k radii
and the k x k distances between centroids, and nothing else (k is a parameter).  Every round is a written table, so lost executors
cost one task each, and only the labels of the last round are kept.

Defined results: vectors that are null, of another length, or hold a null, NaN or infinity take no part, nor do those with a component
beyond 2^27 after scaling (squared distances would leave 64 bits); with fewer than k vectors there are as many centroids as
vectors; equal vectors can begin two clusters, of which the second stays empty; a null id is last in the choice of first
centroids and takes part; repeated rows count each; an empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import forget, map_arrow, scratch, settle_at

#: Vectors of a block.
BLOCK = 4096
#: Components beyond this take no part.
LARGEST = 1 << 27
_ASSIGNED = "vec_id long, cluster int, distance long"
_STEP = "block long, labels binary, parts array<struct<ball:int,n:long,sums:array<long>,far:long>>"


def _kept(vectors: pa.Array, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components as whole numbers."""
    sizes = np.asarray(pc.list_value_length(vectors).fill_null(-1))
    rows = np.flatnonzero(sizes == width)
    flat = vectors.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x)
        fine = (np.abs(x) <= LARGEST).all(axis=1)  # false for NaN
    return rows[fine], x[fine].astype(np.int64)


def _pack(width: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _kept(batch.column("vector"), width, scale)
            ids = batch.column("vec_id").take(pa.array(rows))
            for at in range(0, len(rows), BLOCK):
                some = ids[at : at + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([some.to_pylist()], pa.list_(pa.int64())), pa.array([x[at : at + BLOCK].astype("<i4").tobytes()])], ["ids", "body"])

    return run


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row to a point."""
    away = x - c
    return np.einsum("ij,ij->i", away, away)


@dataclass
class Balls:
    """Centroids, and for each ball the neighbours that its members may go to, nearest first, with D."""

    centroids: np.ndarray
    near: list[list[tuple[int, int]]]
    still: list[bool]

    @classmethod
    def around(cls, centroids: np.ndarray, radii: list[int | None], moved: list[bool]) -> Balls:
        """``radii`` are not squared; None: no bound yet."""
        near, still = [], []
        for i, c in enumerate(centroids):
            apart = squared(centroids, c).tolist()
            mine = [(d, j) for j, d in enumerate(apart) if j != i and (radii[i] is None or d <= 4 * radii[i] ** 2)]
            near.append(sorted(mine))
            still.append(not moved[i] and not any(moved[j] for _, j in mine))
        return cls(centroids, near, still)

    def assign(self, x: np.ndarray, labels: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray, dict[int, int], int]:
        """New labels, distances to the new centroids (-1: not computed, in balls that stand still, unless ``every``), the largest distance
        of those that each ball gave or got, and the number of distances computed."""
        best, far, found, done = labels.copy(), np.full(len(x), -1, np.int64), {}, 0
        for i in np.unique(labels).tolist():
            if self.still[i] and not every:
                continue
            rows = np.flatnonzero(labels == i)
            own = squared(x[rows], self.centroids[i])
            far[rows] = own
            done += len(rows)
            annulus = np.arange(len(rows))
            for apart, j in self.near[i]:
                annulus = annulus[4 * own[annulus] >= apart]  # what lies inside is stable against this neighbour and all later ones
                if not len(annulus):
                    break
                at = rows[annulus]
                d = squared(x[at], self.centroids[j])
                done += len(at)
                win = (d < far[at]) | (d == far[at]) & (j < best[at])
                best[at[win]], far[at[win]] = j, d[win]
        for j in np.unique(best[far >= 0]).tolist():
            found[j] = int(far[best == j].max())
        return best, far, found, done


def _round(balls: Balls, first: bool):
    width = balls.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column("body")[k].as_buffer(), "<i4").reshape(-1, width).astype(np.int64)
                old = np.zeros(len(x), np.int32) if first else np.frombuffer(batch.column("labels")[k].as_buffer(), "<i4")
                new, _, far, _ = balls.assign(x, old)
                parts = []
                gone = np.arange(len(x)) if first else np.flatnonzero(new != old)
                for j in sorted({*far, *new[gone].tolist(), *(() if first else old[gone].tolist())}):
                    came, left = gone[new[gone] == j], gone[:0] if first else gone[old[gone] == j]
                    sums = x[came].sum(axis=0) - x[left].sum(axis=0)
                    parts.append({"ball": j, "n": len(came) - len(left), "sums": sums.tolist(), "far": far.get(j, -1)})
                part = pa.struct([("ball", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("far", pa.int64())])
                yield pa.RecordBatch.from_arrays([batch.column("block")[k : k + 1], pa.array([new.astype("<i4").tobytes()]), pa.array([parts], pa.list_(part))], ["block", "labels", "parts"])

    return run


def _last(balls: Balls, first: bool):
    width = balls.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column("body")[k].as_buffer(), "<i4").reshape(-1, width).astype(np.int64)
                old = np.zeros(len(x), np.int32) if first else np.frombuffer(batch.column("labels")[k].as_buffer(), "<i4")
                new, far, _, _ = balls.assign(x, old, every=True)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(new.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def _root(n: int) -> int:
    """The square root, rounded up."""
    r = math.isqrt(n)
    return r + (r * r < n)


def first_centroids(vectors: DataFrame, vec_id: str, vector: str, k: int, width: int, scale: float, order: Column) -> np.ndarray:
    """The ``k`` vectors that come first in ``order``, ties by their components."""
    v = F.col(vector)
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(F.lit(scale) * x.cast("double")).cast("double")) <= LARGEST))
    rows = vectors.where(v.isNotNull() & fine).select(order.alias("_o"), whole.alias("_v")).orderBy(F.col("_o").asc_nulls_last(), "_v").limit(k).collect()
    return np.array([r["_v"] for r in rows], np.int64).reshape(len(rows), width)


def cluster(vectors: DataFrame, vec_id: str, vector: str, order: Column, k: int = 8, width: int = 64, scale: float = 1024.0, rounds: int = 10) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part, after ``rounds`` rounds and one more
    assignment.  The first centroids are the ``k`` vectors least by ``order``."""
    spark = vectors.sparkSession
    read = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    centroids = first_centroids(read, "vec_id", "vector", k, width, scale, order)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "blocks")
    name = f"ball_blocks_{path.rsplit('-', 1)[-1]}"
    packed = map_arrow(read, _pack(width, scale), "ids array<long>, body binary").withColumn("block", F.monotonically_increasing_id())
    packed.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", path).format("parquet").saveAsTable(name)
    try:
        found = _rounds(spark, name, centroids, rounds)
    finally:
        spark.sql(f"drop table if exists {name}")
        forget(spark, path)
    return found


def _rounds(spark, name: str, centroids: np.ndarray, rounds: int) -> DataFrame:
    blocks, size = spark.table(name), len(centroids)
    counts, sums = [0] * size, [[0] * centroids.shape[1] for _ in range(size)]
    radii, moved, labels = [None] * size, [True] * size, None

    def joined(columns: list[str]) -> DataFrame:
        rows = blocks.select("block", *columns)
        return rows if labels is None else rows.join(spark.read.schema(_STEP).parquet(labels).select("block", "labels").hint("shuffle_hash"), "block")

    for _ in range(rounds):
        if not any(moved):
            break
        balls = Balls.around(centroids, radii, moved)
        path = settle_at(map_arrow(joined(["body"]), _round(balls, labels is None), _STEP), "labels")
        if labels:
            forget(spark, labels)
        parts = spark.read.schema(_STEP).parquet(path).select(F.explode("parts").alias("p")).select("p.ball", "p.n", "p.far", F.posexplode("p.sums").alias("at", "s"))
        added = parts.groupBy("ball", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("far").alias("far"))
        reach: list[int | None] = [r if s else None for r, s in zip(radii, balls.still)]
        for row in added.collect():  # a row a ball and component
            sums[row.ball][row["at"]] += row.s
            if row["at"] == 0:
                counts[row.ball] += row.n
                if row.far >= 0:
                    reach[row.ball] = max(reach[row.ball] or 0, _root(row.far))
        means = np.array([[s // n for s in mine] if n else old for mine, n, old in zip(sums, counts, centroids.tolist())], np.int64)
        shifts = [_root(sum((a - b) ** 2 for a, b in zip(m, c))) for m, c in zip(means.tolist(), centroids.tolist())]
        moved = [s > 0 for s in shifts]
        radii = [(r or 0) + s for r, s in zip(reach, shifts)]  # a ball without members needs no reach
        centroids, labels = means, path
    out = settle_at(map_arrow(joined(["ids", "body"]), _last(Balls.around(centroids, radii, moved), labels is None), _ASSIGNED), "assigned")
    if labels:
        forget(spark, labels)
    rows = spark.read.schema(_ASSIGNED).parquet(out)
    total = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # one row a ball
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of([total.get(j, 0) for j in range(size)], "long").alias("cluster_inertia"),
        F.lit(sum(total.values())).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )
