"""Text utilities: counts, search, byte order, heavy hitters, scatter and gather of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.prefix import ranked
from quern.sources.storage import numbered


def counts(text: str) -> dict[str, Column]:
    """Lines (newlines), words (runs of what is not white space) and bytes of a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return {
        "lines": F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))),
        "words": F.regexp_count(body, F.lit(r"[^\x09-\x0D\x20]+")),
        "bytes": F.octet_length(body),
    }


def found_at(text: str, needle: str) -> Column:
    """Where a text has the needle first, from 1; 0 if nowhere."""
    return F.instr(F.col(text), needle)


def sorted_bytewise(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with each row's place, from 0, in the byte order of its columns."""
    keyed = df.withColumn("__key", F.struct(*[F.col(c) for c in order]))
    return numbered(keyed, "__key", name=name).drop("__key")


def heavy_hitters(df: DataFrame, keys: list[str], size: str, least_percent: float = 0.0) -> DataFrame:
    """(keys, total, n, percent): the groups with at least that part of the sum, heaviest first."""
    groups = df.groupBy(*keys).agg(F.sum(size).alias("total"), F.count("*").alias("n"))
    whole = df.agg(F.sum(size).alias("__whole"))
    found = groups.join(F.broadcast(whole)).withColumn("percent", F.col("total") * 100.0 / F.col("__whole"))  # one row
    return found.where(F.col("percent") >= least_percent).drop("__whole").orderBy(F.desc("total"), *keys)


def scatter_gather(df: DataFrame, source: str, order: str, sinks: int) -> DataFrame:
    """Round-robin over sources: the first of each source, then the second of each; dealt to sinks in that order."""
    turns = ranked(df, [source], [order], "turn")
    places = numbered(turns.withColumn("__key", F.struct(F.col("turn"), F.col(source))), "__key", name="place").drop("__key")
    return places.withColumn("sink", F.pmod(F.col("place"), F.lit(sinks)))
