"""Grouped summaries, shares, rates, order statistics and rank tests on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.prefix import running_total


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text has a match of the pattern."""
    return df.where(F.col(column).rlike(pattern))


def among(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal a value, or are among the values of a list."""
    for name, value in wanted.items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(name) == value)
    return df


def frequencies(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """How often each value stands, most frequent first."""
    return df.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys)


def known(column: str) -> Column:
    """The value, or null for NaN, so that aggregates pass over both."""
    return F.when(~F.isnan(F.col(column).cast("double")), F.col(column))


def means(df: DataFrame, value: str, *keys: str, name: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(known(value)).alias(name))


#: Different values of a group up to which its counts may be held by one task.
FEW_VALUES = 200_000


def medians(df: DataFrame, value: str, *keys: str, name: str = "median") -> DataFrame:
    """Exact medians, nulls and NaN left out; null where nothing is left.

    Groups of few different values are one aggregation, whose state is their counts.  If any group has more, values
    are counted by ranges of their order, and the middle ones are where the running totals pass the half.
    """
    kept = df.select(*keys, known(value).alias("__v"))
    most = kept.groupBy(*keys).agg(F.approx_count_distinct("__v").alias("n")).agg(F.max("n")).first()[0] or 0
    return kept.groupBy(*keys).agg(F.median("__v").alias(name)) if most <= FEW_VALUES else medians_by_totals(kept, "__v", *keys, name=name)


def medians_by_totals(df: DataFrame, value: str, *keys: str, name: str = "median") -> DataFrame:
    """medians() for groups of any number of different values."""
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("__n"))
    upto = running_total(counts, [*keys, value], F.col("__n"), "__upto")
    groups = upto.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(F.col("__upto") - F.col("__n")).alias("__before"), F.sum("__n").alias("__total"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rows = upto.join(F.broadcast(groups) if not keys else groups, same)  # without keys there is one group
    first = F.col("__upto") - F.col("__n") - F.col("__before")
    at = lambda place: F.max(F.when((first <= place) & (place < first + F.col("__n")), F.col(value)))
    low, high = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    return rows.groupBy(*keys).agg(((at(low) + at(high)) / 2).cast("double").alias(name))


def extremes(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(known(value)).alias("least"), F.max(known(value)).alias("most"))


def shares(df: DataFrame, *keys: str, name: str = "percent") -> DataFrame:
    """Counts by group and their part of all rows in percent."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__total"))
    return counts.join(F.broadcast(total)).select(*keys, "n", (F.col("n") * 100.0 / F.col("__total")).alias(name))  # one row


def rates(df: DataFrame, condition: Column, *keys: str, name: str = "rate") -> DataFrame:
    """The percentage of rows of each group for which the condition holds; rows where it is null are left out."""
    return df.groupBy(*keys).agg((F.avg(condition.cast("int")) * 100).alias(name))


def first_and_last(df: DataFrame, *order: str) -> DataFrame:
    """The first and the last row in an order, marked as such; each a top-1, not a sort."""
    down = [F.desc(c) for c in order]
    first = df.orderBy(*order).limit(1).withColumn("place", F.lit("first"))
    return first.unionByName(df.orderBy(*down).limit(1).withColumn("place", F.lit("last")))


def mean_by_key(df: DataFrame, value: str, key: str, name: str = "ratio") -> DataFrame:
    """The mean of each group, divided by the group's key."""
    return df.groupBy(key).agg(F.avg(known(value)).alias("__mean")).select(key, (F.col("__mean") / F.col(key)).alias(name))


def rank_sum(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """(n1, n2, w, z, p): Wilcoxon's rank-sum test of two groups, mid-ranks for ties, two-sided p by the normal approximation.

    Values are counted first, so the running total that gives their ranks is over distinct values.
    """
    rows = df.where(F.col(group).isin([first, second]) & known(value).isNotNull())
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == first).alias("a"), F.count("*").alias("n"))
    upto = running_total(counts, ["v"], F.col("n"), "upto")
    middle = F.col("upto") - (F.col("n") - 1) / 2
    sums = upto.agg(F.sum("a").alias("n1"), F.sum(F.col("n") - F.col("a")).alias("n2"), F.sum(F.col("a") * middle).alias("r"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    w = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    total, product = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")
    spread = F.sqrt(product / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    off = F.col("w") - product / 2
    scored = sums.withColumn("w", w).withColumn("z", (off - F.signum(off) * 0.5) / spread)
    return scored.select("n1", "n2", "w", "z", two_sided(F.col("z")).alias("p"))


def two_sided(z: Column, steps: int = 2000, beyond: float = 10.0) -> Column:
    """The two-sided p-value of a standard normal score: Simpson's rule over the tail, in units of the density at the score.

    exp(-(z + t)^2 / 2) = exp(-z^2 / 2) exp(-z t - t^2 / 2), so small values keep their digits.
    """
    a, h = F.abs(z), beyond / steps
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    tail = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + weight(i) * F.exp(-a * i * h - (i * h) * (i * h) / 2))
    return tail * F.exp(-a * a / 2) * (h / 3 * sqrt(2 / pi))


def mapped(df: DataFrame, column: str, table: dict, name: str) -> DataFrame:
    """A column through a small table of labels; what is not in it gives null."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(column)))


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """A row for each true class, a column for each predicted one, scaled to rows' sums."""
    total = F.count("*")
    return df.groupBy(truth).agg(*[(F.count_if(F.col(predicted) == c) / total).alias(f"p_{c}") for c in classes])


def box_statistics(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, low, q1, median, q3, high, outside): what a box plot draws: exact quartiles, whiskers within 1.5 boxes, values beyond."""
    v = known(value)
    boxes = df.groupBy(*keys).agg(*[F.percentile(v, q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    joined = df.join(boxes, list(keys)) if keys else df.join(F.broadcast(boxes))  # one box
    inside = (v >= F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) & (v <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return joined.groupBy(*keys, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("outside"))


def density(df: DataFrame, value: str, at: Sequence[float], width: float, *keys: str) -> DataFrame:
    """(keys, at, density): a Gaussian kernel density at some places; a column for each of them, summed in one pass."""
    v, n = known(value), F.count(known(value))
    scale = width * sqrt(2 * pi)
    sums = [(F.sum(F.exp(-((v - x) / width) * ((v - x) / width) / 2)) / (n * scale)).alias(f"d{i}") for i, x in enumerate(at)]
    wide = df.groupBy(*keys).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("at"), F.col(f"d{i}").alias("density")) for i, x in enumerate(at)]))
    return wide.select(*keys, each.alias("e")).select(*keys, "e.at", "e.density")


def local_regression(df: DataFrame, x: str, y: str, at: Sequence[float], width: float, *keys: str) -> DataFrame:
    """(keys, at, estimate): at each place the line of least squares with tricube weights within a width (loess of degree 1)."""
    u, v, sums = F.col(x).cast("double"), F.col(y).cast("double"), []
    for i, place in enumerate(at):
        near = F.abs(u - place) / width
        w = F.when(near < 1, F.pow(1 - F.pow(near, F.lit(3)), F.lit(3))).otherwise(0.0)
        d = u - place
        sums += [F.sum(w).alias(f"w{i}"), F.sum(w * d).alias(f"x{i}"), F.sum(w * d * d).alias(f"xx{i}"), F.sum(w * v).alias(f"y{i}"), F.sum(w * d * v).alias(f"xy{i}")]
    wide = df.where(u.isNotNull() & v.isNotNull()).groupBy(*keys).agg(*sums)
    c = F.col
    line = lambda i: F.try_divide(c(f"xx{i}") * c(f"y{i}") - c(f"x{i}") * c(f"xy{i}"), c(f"w{i}") * c(f"xx{i}") - c(f"x{i}") * c(f"x{i}"))
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("at"), line(i).alias("estimate")) for i, p in enumerate(at)]))
    return wide.select(*keys, each.alias("e")).select(*keys, "e.at", "e.estimate")
