"""Registered queries: those with SQL against it, all of them for the columns and cases that they promise."""

import hashlib
import os
import zlib

import duckdb
import pytest

from quern.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_as_sql(spark, duck, name):
    df, rel = registry.QUERIES[name](spark, DIR), duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = rel.select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_digests_of_media_and_shards(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in registry.op10_media_columns(spark, DIR).collect():
        body = texts[r.doc_id]
        payload = body + b"\xff" * (-len(body) % 576 or (0 if body else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(body), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    rows = registry.op1_sharding(spark, DIR).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    assert {r.law for r in rows} == {"bytes"} and {r.shard for r in rows} == set(range(40))


def test_types(spark):
    long, text, flag = "bigint", "string", "boolean"
    want = {
        "op1_sharding": {"doc_id": long, "size": long, "text_crc32": long, "law": text, "shard": "int", "slot": long, "grown_shard": "int"},
        "op2_lm_scoring": {"doc_id": long, "held_out": flag, "n_tokens": long, "n_known": long, "train_tokens": long, "base_score": "double", "score": "double"},
        "op4_decontamination": {"doc_id": long, "n_words": long, "n_hit": long, "n_items": long, "items_sha256": text, "contaminated": flag},
        "op6_simhash_dedup": {"doc_id": long, "fingerprint": text, "component_id": long},
        "op7_language_id": {"doc_id": long, "held_out": flag, "lang_pred": text, "score": "double"},
        "op8_quality": {"doc_id": long, "held_out": flag, "score": "double", "predicted": "int"},
        "op9_secret_scan": {"doc_id": long, "n_assign": long, "n_access": long, "n_hex": long, "base_sha256": text, "spans": text},
        "op10_media_columns": {"doc_id": long, "n_bytes": long, "payload_bytes": long, "payload_sha256": text, "tail_crc32": long, "media_bytes": long, "media_sha256": text, "feature": text},
    }
    for name, columns in want.items():
        got = dict(registry.QUERIES[name](spark, DIR).dtypes)
        assert columns.items() <= got.items(), name
