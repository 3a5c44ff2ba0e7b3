"""Writers of results and the scans of tables that reports start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import section_rollup


def read_csv(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """A CSV table with a header and trimmed column names; missing columns are an error that names them."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """One sheet by pandas on the driver: a report file is small.  Needs an Excel reader for pandas."""
    import pandas as pd

    rows = pd.read_excel(path)
    return spark.createDataFrame(rows.rename(columns=lambda c: str(c).strip()))


def write_texts(texts: DataFrame, path: str, partition: list[str]) -> None:
    """One text a row, below a folder for each partition value."""
    texts.write.mode("overwrite").partitionBy(*partition).option("lineSep", "\n").text(path)


def write_table(rows: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """A CSV table with quoting, those of ``columns`` that exist, in their order."""
    kept = rows.select(*[c for c in columns if c in rows.columns])
    (kept.orderBy(*order) if order else kept).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def metric_rows(rows: DataFrame, metrics: list[str], overall: bool, least_files: int = 1) -> DataFrame:
    """section, run_label, file and metrics: the detail, then a row a section with at least ``least_files`` files, then
    (with ``overall``) one over all; ``level`` 0, 1, 2 is the order."""
    detail = rows.select(F.lit(0).alias("level"), "section", "run_label", "file", *[F.col(m).cast("double").alias(m) for m in metrics])
    rolled = section_rollup(rows, metrics)
    whole = F.col("level") == "ALL"
    kept = rolled.where((whole & F.lit(overall)) | (~whole & (F.col("n_rows") >= least_files)))
    summary = kept.select(F.when(whole, 2).otherwise(1).alias("level"), "section", F.when(whole, "OVERALL_AVG").otherwise("SECTION_AVG").alias("run_label"), F.lit("SECTION_MACRO_AVG").alias("file"), *metrics)
    return detail.unionByName(summary)


def metric_json(rows: DataFrame, metrics: list[str], section: str = "section") -> DataFrame:
    """One row a section: its files' metrics and their averages as a JSON document."""
    entry = F.struct("file", *metrics)
    average = F.struct(*[F.round(F.avg(m), 4).alias(m) for m in metrics])
    return rows.groupBy(section).agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("per_file"), average.alias("macro_avg"))).alias("json"))


def task_xml(tasks: DataFrame, key: str = "model_id") -> DataFrame:
    """key, xml: task tables that ``documents.tasks`` reads, tasks in the order of ``ord``."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    people = F.transform("performers", lambda p: F.struct(p["unit"].alias("unit"), p["role"].alias("role")))
    spared = F.transform("exceptions", lambda e: F.struct(e["description"].alias("_description"), F.nullif(e["ref"], F.lit("")).alias("_ref")))
    task = F.struct(
        F.col("task_id").alias("_id"),
        F.col("label"),
        F.struct(people.alias("performer")).alias("performers"),
        F.struct(text("deontic_type").alias("_type"), text("deontic_modality").alias("_modality")).alias("deontic"),
        F.struct(F.col("conditions").alias("condition")).alias("conditions"),
        F.struct(spared.alias("exception")).alias("exceptions"),
        F.struct(text("source_article").alias("_article"), text("source_paragraph").alias("_paragraph")).alias("source-ref"),
    )
    one = tasks.select(key, "ord", F.to_xml(task, {"rowTag": "task", "indentation": "  "}).alias("_x"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_x"))), lambda x: F.regexp_replace(x["_x"], r"(?m)^", "  ")), "\n")
    return one.groupBy(key).agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<tasks>\n'), listed, F.lit("\n</tasks>")).alias("xml"))


def pretty_xml(xml: Column) -> Column:
    """Without blank lines."""
    return F.regexp_replace(xml, r"(?m)^[ \t]*\r?\n", "")
