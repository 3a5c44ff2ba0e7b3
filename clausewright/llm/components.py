"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a long, b long); label is the least node it reaches.

    Minimum and redistribution are an aggregation and a join, so no node's neighbours are gathered in one
    row; each round is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = both.join(least, "a")
        if large:
            moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    now = settle(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = settle(star(star(now, True), False), "edges")
    labels = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
