"""Tables of metrics: every run, means over runs, raw against preprocessed; and their LaTeX rows.

Numbers are DataFrames; ``latex`` renders the few rows of a finished report.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The rows that hold averages, and the runs that reports count.
SUMMARY_FILE, SUMMARY_RUN = "SECTION_MACRO_AVG", "SECTION_AVG"
RUNS = ["1", "2", "3"]


def document_number(file: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(file, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(0))


def run_number(run: Column) -> Column:
    return F.regexp_extract(run, r"run_?(\d+)", 1)


def detail_rows(rows: DataFrame, numeric_order: bool = True) -> DataFrame:
    """Rows without averages, with doc_num, run_num and a dense document index (by number, or by name as text)."""
    kept = rows.where((F.col("file") != SUMMARY_FILE) & ~F.coalesce(F.contains("run_label", F.lit(SUMMARY_RUN)), F.lit(False)))
    kept = kept.withColumn("doc_num", document_number(F.col("file"))).withColumn("run_num", run_number(F.col("run_label")))
    names = kept.select("file", "doc_num").distinct()
    index = F.dense_rank().over(Window.orderBy("doc_num" if numeric_order else "file"))
    return kept.join(names.withColumn("doc_index", index), ["file", "doc_num"])


def averaged(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """doc_index, metrics: means over the counted runs, and a last row (null index) of the mean of those means."""
    per = detail_rows(rows.where(run_number(F.col("run_label")).isin(RUNS))).groupBy("doc_index").agg(*[F.avg(m).alias(m) for m in metrics])
    return per.unionByName(per.agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("doc_index", F.lit(None).cast("int")))


def run_average(rows: DataFrame, run: str, metrics: list[str], least_files: int = 2) -> DataFrame:
    """run, metrics, n_files: means within a run of at least ``least_files`` files."""
    per = rows.groupBy(run).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_files"))
    return per.where(F.col("n_files") >= least_files)


def in_section(rows: DataFrame, section: str) -> DataFrame:
    return rows.where(F.col("section") == section)


def all_runs(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """doc_index, run_num, metrics: every run, and a last row (nulls) of their mean."""
    per = detail_rows(rows).select("doc_index", "run_num", *[F.col(m).cast("double").alias(m) for m in metrics])
    last = per.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit(None).cast("int").alias("doc_index"), F.lit(None).cast("string").alias("run_num"), *metrics)
    return per.unionByName(last)


def absolute(text: Column) -> tuple[Column, Column]:
    """(matched, gold) of ``m/n``; zeros for anything else."""
    part = lambda g: F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*(\d+)\s*/\s*(\d+)\s*$", g), F.lit("")).cast("int"), F.lit(0))
    return part(1), part(2)


def better_of_two(rows: DataFrame, metric: str, doc: str = "doc", run: str = "run", kind: str = "kind") -> DataFrame:
    """doc, run, raw, prep, raw_bold, prep_bold: the two kinds side by side in one grouping; the strictly greater is
    bold, and neither where one is missing or they tie."""
    pick = lambda k: F.max(F.when(F.col(kind) == k, F.col(metric)))
    met = rows.groupBy(doc, run).agg(pick("raw").alias("raw"), pick("preprocessed").alias("prep"))
    return met.withColumn("raw_bold", F.coalesce(F.col("raw") > F.col("prep"), F.lit(False))).withColumn("prep_bold", F.coalesce(F.col("prep") > F.col("raw"), F.lit(False)))


def completeness_by_document(rows: DataFrame, recall: str, matched: str, gold: str) -> DataFrame:
    """kind, doc, recall, matched, gold: means over runs, counts rounded half to even."""
    return rows.groupBy("kind", "doc").agg(F.avg(recall).alias("recall"), F.bround(F.avg(matched), 0).cast("int").alias("matched"), F.bround(F.avg(gold), 0).cast("int").alias("gold"))


def completeness_summary(rows: DataFrame, recall: str, matched: str, gold: str) -> DataFrame:
    """kind, recall, matched, gold: recalls summed over the documents of the kind and divided by the documents of both
    kinds; counts are sums of the rounded means."""
    per = completeness_by_document(rows, recall, matched, gold)
    n_docs = rows.agg(F.count_distinct("doc").alias("_n"))
    sums = per.groupBy("kind").agg(F.sum("recall").alias("_r"), F.sum("matched").alias("matched"), F.sum("gold").alias("gold"))
    return sums.join(F.broadcast(n_docs)).select("kind", (F.col("_r") / F.nullif(F.col("_n"), F.lit(0))).alias("recall"), "matched", "gold")  # one row of a total


def correctness_summary(rows: DataFrame, score: str, counts: str, folder: str = "folder") -> DataFrame:
    """kind, score, matched, gold of the counted runs: the mean over all rows of a kind (the run folder's begin, raw or
    preprocessed); matched counts of all runs, gold counts of each document's first run."""
    kind = F.when(F.startswith(folder, F.lit("raw")), "raw").when(F.startswith(folder, F.lit("preprocessed")), "preprocessed")
    matched, gold = absolute(F.col(counts))
    kept = rows.withColumn("kind", kind).where(F.col("kind").isNotNull() & run_number(F.col(folder)).isin(RUNS)).select("kind", "file", folder, score, matched.alias("_m"), gold.alias("_g"))
    per = kept.groupBy("kind", "file").agg(F.sum(score).alias("_s"), F.count(score).alias("_n"), F.sum("_m").alias("_m"), F.min_by("_g", folder).alias("_g"))
    return per.groupBy("kind").agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias(score), F.sum("_m").alias("matched"), F.sum("_g").cast("long").alias("gold"))


@pandas_udf(T.StringType())
def prf_cell(p: pd.Series, r: pd.Series, f: pd.Series) -> pd.Series:
    """``p/r/f`` with two digits each, rounded by the exact binary value (ties to even), as reports show them."""
    return pd.Series([f"{a:.2f}/{b:.2f}/{c:.2f}" for a, b, c in zip(p, r, f)])


def bold(cell: Column, flag: Column) -> Column:
    return F.when(flag, F.concat(F.lit("\\textbf{"), cell, F.lit("}"))).otherwise(cell)


def latex_row(cells: list[Column]) -> Column:
    return F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\"))


def latex(rows: DataFrame, order: list[str], cells: list[Column], heads: list[str], caption: str, label: str) -> str:
    """A table environment.  A report has a row a document and run, so its text is made on the driver."""
    lines = [r.line for r in rows.orderBy(*order).select(latex_row(cells).alias("line")).collect()]
    spec = "l" + " c" * (len(heads) - 1)
    top = ["\\begin{table}[h]", "\\centering", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{{spec}}}", "\\toprule", " & ".join(heads) + " \\\\", "\\midrule"]
    return "\n".join([*top, *lines, "\\bottomrule", "\\end{tabular}", "\\end{table}"])


def show_scores(rows: DataFrame, columns: list[str], n: int = 100) -> None:
    """The console table."""
    rows.select(*columns).show(n, truncate=False)
