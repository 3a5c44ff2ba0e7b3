import pytest
from pyspark.sql import functions as F

from clausewright.llm.sampling import least_hashed


def plain(rows, size, by):
    groups = {}
    for h, i, x in rows:
        groups.setdefault(x if by else None, []).append((h, i is not None, i or 0, x))
    return sorted(r for g in groups.values() for r in sorted(g)[:size])


@pytest.mark.parametrize("by", [None, "lang"])
@pytest.mark.parametrize("size", [1, 5, 40, 10_000])
@pytest.mark.parametrize("n", [0, 3, 4_000])
def test_equals_sorting_all(spark, n, size, by):
    ids = spark.range(n, numPartitions=7).select(F.col("id").alias("doc_id"))
    odd = spark.createDataFrame([(7,)] * min(n, 30) + [(None,)] * min(n, 2), "doc_id long")  # repeated and null ids
    rows = ids.union(odd).withColumn("lang", F.when(F.col("doc_id") % 97 == 0, "rare").otherwise("common"))
    want = plain([(r.h, r.doc_id, r.lang) for r in rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang").collect()], size, by)
    got = least_hashed(rows, size, by)
    assert got.columns == ["doc_id", "lang"]
    assert sorted((r.h, r.doc_id is not None, r.doc_id or 0, r.lang) for r in got.select(F.xxhash64("doc_id").alias("h"), "*").collect()) == want


@pytest.mark.parametrize("by", [None, "lang"])
def test_few_rows_pass_the_bound(spark, by):
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("lang"))
    plan = least_hashed(rows, 200, by)
    assert plan.count() == 200
    power = F.floor(F.log2(F.greatest(F.xxhash64("doc_id").cast("double") + F.lit(2.0**63), F.lit(1.0))))
    last = plan.agg(F.max(power)).first()[0]
    assert rows.where(power <= last).count() < 1_000
