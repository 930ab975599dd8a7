"""Sparse matrices as rows (i, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """The sum, or the difference with sign -1; what cancels stays as zero."""
    other = b.select("i", "j", (F.col("v") * sign).alias("v"))
    return a.select("i", "j", "v").unionByName(other).groupBy("i", "j").agg(F.sum("v").alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product: entries meet by the inner index, products are summed by place."""
    left = a.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def multiply_blocked(a: DataFrame, b: DataFrame, block: int) -> DataFrame:
    """The product by tiles: a tile of each side meets once for each tile of the result, so no inner index is hot."""
    tile = lambda c: F.floor(F.col(c) / block)
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).withColumn("bi", tile("i")).withColumn("bk", tile("k"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")).withColumn("bk", tile("k")).withColumn("bj", tile("j"))
    part = left.join(right, ["bk", "k"]).groupBy("i", "j", "bk").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return part.groupBy("i", "j").agg(F.sum("v").alias("v"))
