"""A training-data pipeline over `documents`: language ID, near-dedup, decontamination, secret scans, encoding.

Each stage takes what the one before kept.  Rows leave the first three stages: texts without a language, all but one
of each group of near-duplicates, and texts that hold benchmark passages.  The fourth replaces secrets in the texts,
the last gives the piece ids of each text.  SQL cannot express the stages; the tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import credentials, langid, pieces, positions, simhash
from quern.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the model learns from a bounded sample of the labelled rows at hand."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard 0.8 or more, met by fingerprint blocks), that with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth."""
    return positions.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return credentials.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as piece ids, with what decoding gives back checked."""
    model = pieces.load()
    back = pieces.decode(pieces.encode(docs.select("doc_id", "text", "lang", "source"), model), model)
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_ids"), F.col("text").eqNullSafe(F.col("decoded")).alias("restored"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage{number}")
    return docs
