"""Bounded samples: the rows of the least hashed doc_ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def least_hashed(rows: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """The ``size`` rows of least xxhash64(doc_id), ties to the lesser doc_id, of each value of column ``by`` (of all
    rows without it); columns unchanged, all rows if there are fewer.

    Rows are counted by the power of two their hash lies below first, and those above the power where ``size`` rows
    are reached fall out where they are scanned: about twice ``size`` rows of a value meet in one task, however many
    rows and partitions there are.  A null doc_id counts as a value, rows of one doc_id count each, and an empty
    table gives an empty one.  ``by`` should have few values: one bound for each is broadcast."""
    key = [by] if by else []
    hashed = [F.xxhash64("doc_id"), F.col("doc_id")]
    # from the least long on; never below one, and ascending with the hash
    power = F.floor(F.log2(F.greatest(hashed[0].cast("double") + F.lit(2.0**63), F.lit(1.0))))
    names = rows.columns
    rows = rows.withColumn("_power", power)
    counts = rows.groupBy(*key, "_power").agg(F.count("*").alias("_n"))
    lower = Window.partitionBy(*key).orderBy("_power").rowsBetween(Window.unboundedPreceding, -1)
    bounds = counts.withColumn("_lower", F.coalesce(F.sum("_n").over(lower), F.lit(0))).where(F.col("_lower") < size).groupBy(*key).agg(F.max("_power").alias("_bound"))
    if not by:
        bound = F.lit(bounds.first()["_bound"]).cast("long")  # one number
        return rows.where(F.col("_power") <= bound).orderBy(*hashed).limit(size).select(*names)
    near = rows.join(F.broadcast(bounds), by).where(F.col("_power") <= F.col("_bound"))
    first = F.row_number().over(Window.partitionBy(by).orderBy(*hashed))
    return near.withColumn("_place", first).where(F.col("_place") <= size).select(*names)
