"""Averages over rows of metrics: by run, by section, over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def macro_average(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics], F.count("*").alias("n_rows"))


def section_rollup(rows: DataFrame, metrics: list[str], section: str = "section") -> DataFrame:
    """One pass: a row a section and one over all (level 'SECTION' and 'ALL')."""
    out = rows.rollup(section).agg(F.grouping(section).alias("_g"), *[F.round(F.avg(m), 4).alias(m) for m in metrics], F.count("*").alias("n_rows"))
    return out.select(F.coalesce(section, F.lit("ALL")).alias(section), F.when(F.col("_g") == 1, "ALL").otherwise("SECTION").alias("level"), *metrics, "n_rows")


def mean_of_means(rows: DataFrame, outer: list[str], inner: list[str], metrics: list[str]) -> DataFrame:
    """Mean over per-``inner`` means."""
    first = rows.groupBy(*outer, *inner).agg(*[F.avg(m).alias(m) for m in metrics])
    return first.groupBy(*outer).agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics])


def absolute_totals(rows: DataFrame, doc: str, run: str, matched: str, gold: str) -> DataFrame:
    """Matched and gold totals of a document over its runs, and the variant that takes gold from the first run only."""
    per = rows.groupBy(doc).agg(F.sum(matched).alias("matched_total"), F.sum(gold).alias("gold_total"), F.min_by(gold, run).alias("gold_first_run"))
    return per
