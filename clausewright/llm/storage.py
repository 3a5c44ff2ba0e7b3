"""Shared scratch storage.

Executors and the driver only share the folder that ``spark.checkpoint.dir`` names, so every
intermediate table and every file an operator writes goes below it.  In local mode, where the
setting may be unset, a temporary folder of our own is used.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Scratch paths of this process, for ``swept``.
made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The qualified URI of the shared scratch folder of this session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="clausewright-")
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return made[-1]


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at the end every scratch path made inside, but for those that are put into the list it gives."""
    begun, keep = len(made), []
    try:
        yield keep
    finally:
        for path in made[begun:]:
            if path not in keep:
                forget(spark, path)
        del made[begun:]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost
    executor costs nothing that was written."""
    return df.sparkSession.read.schema(df.schema).parquet(settle_at(df, name))


def settle_at(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet to the shared folder; the path."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def open_table(uri: str) -> Iterator[pa.RecordBatch]:
    """The rows of a settled table, inside a task, a batch at a time."""
    from pyarrow import dataset, fs

    store, path = fs.FileSystem.from_uri(uri)
    yield from dataset.dataset(path, filesystem=store, format="parquet").to_batches(batch_size=16)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def put_file(uri: str, content: bytes) -> None:
    """Write one file atomically: under a private name first, then renamed, so that a retried or
    speculative task replaces the file by equal content and readers never see half of one."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    private = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}"
    with store.open_output_stream(private) as out:
        out.write(content)
    store.move(private, path)


def release() -> None:
    """Give memory that nothing holds any longer back to the system: workers live on between tasks and stages, and
    the allocators would keep the peak of each."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with ``release()`` at the end of each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)
