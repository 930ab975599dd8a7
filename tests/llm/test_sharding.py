"""Sharding against a plain sort and running sum, and its defined cases."""

import zlib

from pyspark.sql import functions as F

from quern.llm import sharding


def check(rows, shards, got):
    """rows: (key, text); got: rows of the operator.  Each shard is an interval whose bytes are within a row of the mean."""
    assert len(got) == len(rows)
    sizes = sorted(((k is not None, k), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id), r.size, r.text_crc32) for r in got) == sizes
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    mean, most = sum(s for _, s, _ in sizes) / shards, max(s for _, s, _ in sizes)
    for r in by.values():
        assert sorted(x.slot for x in r) == list(range(len(r)))
    for s in range(shards):
        assert abs(sum(x.size for x in by.get(s, [])) - mean) <= most
    order = [(x.doc_id is not None, x.doc_id) for s in sorted(by) for x in sorted(by[s], key=lambda x: x.slot)]
    assert order == sorted(order)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], 40, sharding.shard(docs, 40).collect())


def test_hot_key_and_defined_cases(spark):
    rows = [(None, None), (None, ""), (3, "é" * 50), *[(7, "same")] * 400, *[(i, "x" * (i % 90)) for i in range(500)], (900, "y" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("shard", F.lit(None).cast("int"))
    check(rows, 5, sharding.shard(docs, 5, samples=4).collect())
    assert sharding.shard(docs.limit(0), 5).collect() == []
    one = sharding.shard(docs.where("doc_id = 900"), 5).collect()
    assert [(r.size, r.slot) for r in one] == [(3016, 0)]


def test_overfull_ranges_are_cut_again(spark):
    slim = spark.range(3000).select(F.struct(F.lit(1).alias("key"), F.xxhash64("id").alias("h"), F.lit(20).cast("long").alias("size"), F.col("id").alias("tie")).alias("k"), F.lit(20).cast("long").alias("size"))
    _, measured = sharding.splitters_of(slim, 60_000, 30, 1)
    assert max(r["bytes"] for r in measured.collect()) <= 2 * 2000
