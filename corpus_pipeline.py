"""A corpus pipeline: language ID, toxicity, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; ``run``
writes it as Parquet below the shared folder and rereads it for the next stage; what only a finished stage needed is
deleted.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewright.llm import language_id, minhash, packing, substring_dedup, toxicity
from clausewright.llm.queries import remainder, table, vocabulary
from clausewright.llm.storage import forget, settle_at, swept

#: A text whose best language knows less of its n-grams than this is in no learned language.
KNOWN_SHARE = 0.25
#: Texts with at least this score are toxic.
TOXIC_SCORE = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts in no learned language."""
    model = language_id.fit(docs.where(remainder(4) != 2))
    return language_id.drop_unknown(docs, model, KNOWN_SHARE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic texts."""
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1)))
    return toxicity.drop_toxic(docs, model, TOXIC_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, 0.8)."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every word of a repeated run of 35 words out of the texts."""
    return substring_dedup.remove_repeated(docs, width=35, keep_columns=True)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 1024 ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, window=1024)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with swept(spark) as keep:
            found = stage(spark, docs, sf_dir)
            before, written = written, settle_at(found, f"stage-{name}")
            keep.append(written)
        docs = spark.read.schema(found.schema).parquet(written)
        if before:
            forget(spark, before)
    return docs
