"""Intermediate tables: written once to the folder that driver and executors share, so that a loop's plan stays short and a lost executor
costs nothing that was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it may be unset, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="clausewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables of one computation; ``drop`` deletes one that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.tables)}"
        df.write.parquet(path)
        self.tables.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.tables[-1][0]

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(next(p for table, p in self.tables if table is df))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
