"""Running totals and ranks over ordered rows, without a single task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.storage import stored


def _dealt(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in ranges of the order, each marked with its range's number; written, so that it stays as it is."""
    return stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before and including each, in the order of the columns.

    Ranges are summed, a row for each range gives the offsets, and windows only run within a range.
    """
    dealt = _dealt(df.withColumn("__value", value), [F.col(c) for c in order])
    sums = dealt.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.withColumn("__run", F.sum("__value").over(within)).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__run")).drop("__part", "__value", "__run", "__before")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with each row's number, from 1, among the rows of its group; a group may span many tasks."""
    dealt = _dealt(df, [F.col(c) for c in (*by, *order)])
    keys = ["__part", *by]
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = dealt.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [numbered[k].eqNullSafe(offsets[k]) for k in keys]
    joined = numbered.join(offsets, same)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("__before") + F.col("__row")).alias(name))
