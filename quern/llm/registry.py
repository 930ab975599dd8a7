"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import credentials, flac, langid, licenses, mixing, pieces, positions, quality, sharding, simhash
from quern.llm.common import crc_mod, stored, table


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positions.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select(F.col("key").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_mod("doc_id", 4)
    model = langid.fit(docs, train=fold != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", of(1).alias("n_assign"), of(2).alias("n_access"), of(3).alias("n_hex"), F.sha2(credentials.listed(F.col("base")), 256).alias("base_sha256"), credentials.listed(F.col("spans")).alias("spans"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_units", "n_matches", "n_windows", F.concat_ws(",", "licenses").alias("licenses"), "best_dice")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load()
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = pieces.decode(coded, model)
    return back.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.col("text").eqNullSafe(F.col("decoded")).alias("restored"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train=fold != 0)
    found = quality.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    media = flac.encode_column(docs, "body").select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "media")
    back, payload = flac.read_back(stored(media, "media")), F.col("payload")
    tail = F.crc32(F.substring(payload, -32, 32))
    return back.select("doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_lm_scoring, op3_license_scan, op4_decontamination, op5_sentencepiece,
        op6_simhash_dedup, op7_language_id, op8_quality, op9_secret_scan, op10_media_columns,
    )
}
ORACLES: dict[str, str] = {"op1_sharding": sharding.oracle(), "op3_license_scan": licenses.oracle(), "op4_decontamination": positions.oracle(), "op7_language_id": langid.oracle(), "op9_secret_scan": credentials.oracle()}
