"""Bags (multisets): matching that uses up what it matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag_counts(gold: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """tp, fp, fn for each key: a value counts as often as it occurs on both sides.  Both sides are counted before
    they meet, so repeated values don't multiply."""
    side = lambda df, n: df.groupBy(*keys, *values).agg(F.count("*").alias(n))
    met = side(gold, "_g").join(side(found, "_f"), [*keys, *values], "full_outer").na.fill(0, ["_g", "_f"])
    both = F.least("_g", "_f")
    return met.groupBy(*keys).agg(F.sum(both).alias("tp"), F.sum(F.col("_f") - both).alias("fp"), F.sum(F.col("_g") - both).alias("fn"))
