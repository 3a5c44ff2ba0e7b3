"""Token-ID output: documents to wavelet-matrix shards, and back.

``write_shards`` deals the documents by ranges of doc_id, so that shards follow each other in ascending
doc_id order; each task cuts its sorted rows into shards of ``wavelet.SHARD_IDS`` ids and puts each into
the shared folder.  The only data about all shards is a small manifest, itself a distributed table.

Defined results: a null text is empty (only the end id); a null doc_id sorts first and is kept; equal
doc_ids order by text; repeated rows stay rows of their own; an empty table gives no shard.  Only the
columns doc_id and text are read, so others may have any name.  A document is never split over shards,
so a shard is as large as its largest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wavelet
from .storage import map_arrow, put_file, scratch
from .wordbpe import encoder, slices

_MANIFEST = "shard string, part int, n_docs long, n_ids long"
_DOCS = "shard string, doc_id long, at long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write shards below ``folder``; returns the manifest (shard file name, part, n_docs, n_ids)."""
    size = wavelet.SHARD_IDS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), []
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []

        def flush() -> None:
            name = f"{part:08d}-{len(made):06d}.wm"
            whole = np.concatenate(ids)
            put_file(f"{folder}/{name}", wavelet.dump(names, lengths, whole))
            made.append((name, part, len(names), len(whole)))
            ids.clear(), names.clear(), lengths.clear()

        encode, held = encoder(tokenizer), 0
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for low, high in slices(texts):
                for doc_id, got in zip(doc_ids[low:high], encode(texts[low:high])):
                    if ids and held + len(got) + 1 > size:
                        flush()
                        held = 0
                    ids.append(np.append(got, got.dtype.type(end_id)))
                    names.append(doc_id)
                    lengths.append(len(got) + 1)
                    held += len(got) + 1
        if ids:
            flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["shard", "part", "n_docs", "n_ids"])

    key = F.col("doc_id").asc_nulls_first()
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(key).sortWithinPartitions(key, F.col("text").asc_nulls_first())
    return map_arrow(dealt, write, _MANIFEST)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, at, n_tokens, ids_crc32) of each document, from the files; ``at`` counts inside the shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                names, lengths, matrix = wavelet.load(content.as_py())
                ids, ends = matrix.ids().astype("<u4"), np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rpartition("/")[2]] * len(names)), pa.array(names, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64())],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    return map_arrow(files, read, _DOCS)


def token_offsets(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as shards, read them back: doc_id, start, n_tokens, ids_crc32, shard.

    ``start`` is a prefix sum over the manifest: inside a part over its shards, over parts by totals, so
    no window takes more than a part's shards or one row a part.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "token-shards")
    manifest = f"{folder}/manifest"
    write_shards(docs, tokenizer, end_id, f"{folder}/shards").write.parquet(manifest)
    shards = spark.read.schema(_MANIFEST).parquet(manifest)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.join(parts, "part").select("shard", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    rows = read_shards(spark, f"{folder}/shards").join(starts, "shard")
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")
