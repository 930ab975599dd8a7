"""Spanning trees and random graphs as edge tables (a, b, w)."""

from __future__ import annotations

from collections.abc import Callable
from math import log2, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.ml import uniform
from quern.sources.storage import stored


#: Edges up to which a forest is found by the driver, in one go; a checked bound.
FEW_EDGES = 50_000


def _small_forest(rows: list) -> list:
    """The edges of a minimum spanning forest, lightest first; nodes point to ones nearer to their component's name."""
    name: dict = {}
    picked = []
    for row in sorted(rows, key=lambda r: (r.w, r.a, r.b)):
        ends = []
        for node in (row.a, row.b):
            path = []
            while (up := name.get(node, node)) != node:
                path.append(node)
                node = up
            name.update(dict.fromkeys(path, node))
            ends.append(node)
        if ends[0] != ends[1]:
            name[max(ends)] = min(ends)
            picked.append(row)
    return picked


def spanning_forest(edges: DataFrame, most_rounds: int = 40, few: int | None = None) -> DataFrame:
    """The edges (a, b, w) of a minimum spanning forest, by rounds of lightest outgoing edges; one without a weight is none.

    Each round every component takes its lightest edge to another; ties go to the smaller edge, so no circles
    arise.  Components are then merged by pointer jumping.  Rounds follow the logarithm of the number of nodes.
    """
    edges = stored(edges.where("a <> b and w is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")), "edges")
    if edges.count() <= (FEW_EDGES if few is None else few):
        return edges.sparkSession.createDataFrame(_small_forest(edges.collect()), edges.schema)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stored(nodes.withColumn("root", F.col("node")), "labels")
    chosen = None
    for _ in range(most_rounds):
        one = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        open_edges = stored(edges.join(one, "a").join(two, "b").where("ra <> rb"), "open")
        if open_edges.isEmpty():
            break
        both = open_edges.select("a", "b", "w", F.col("ra").alias("r"), F.col("rb").alias("to")).union(open_edges.select("a", "b", "w", F.col("rb"), F.col("ra")))
        best = stored(both.groupBy("r").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("r", "e.w", "e.a", "e.b", "e.to"), "best")
        picked = best.select("a", "b", "w").distinct()
        chosen = picked if chosen is None else chosen.union(picked)
        # of two components that chose each other the smaller becomes the root; all others point on
        back = best.select(F.col("r").alias("to"), F.col("to").alias("back"))
        parent = best.join(back, "to", "left").select("r", F.when((F.col("back") == F.col("r")) & (F.col("r") < F.col("to")), F.col("r")).otherwise(F.col("to")).alias("up"))
        parent = stored(parent, "parents")
        while True:
            above = parent.select(F.col("r").alias("up"), F.col("up").alias("upper"))
            jumped = stored(parent.join(above, "up", "left").select("r", F.coalesce("upper", "up").alias("new"), "up"), "jump")
            settled = jumped.where("new <> up").isEmpty()
            parent = jumped.select("r", F.col("new").alias("up"))
            if settled:
                break
        labels = stored(labels.join(parent.withColumnRenamed("r", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
    else:
        raise RuntimeError(f"the forest is not whole after {most_rounds} rounds")
    return (chosen if chosen is not None else edges.limit(0)).select("a", "b", "w")


def random_graph(spark: SparkSession, nodes: int, seed: int = 0, most: float = 1.0) -> DataFrame:
    """The complete graph on 0..nodes-1 with uniform weights from a hash; edges heavier than `most` are not made."""
    every = spark.range(nodes * (nodes - 1) // 2)
    # the pair with number k: the larger node b has b (b - 1) / 2 pairs before its own
    b = F.floor((1 + F.sqrt(1 + 8.0 * F.col("id"))) / 2).cast("long")
    b = F.when(b * (b - 1) / 2 > F.col("id"), b - 1).when((b + 1) * b / 2 <= F.col("id"), b + 1).otherwise(b)
    pairs = every.withColumn("b", b).withColumn("a", (F.col("id") - F.col("b") * (F.col("b") - 1) / 2).cast("long"))
    return pairs.select("a", "b", uniform(F.col("a"), F.col("b"), F.lit(seed)).alias("w")).where(F.col("w") <= most)


def tree_of(edges: Callable[[float], DataFrame], nodes: int, first: float, last: float) -> DataFrame:
    """The minimum spanning tree of a graph whose edges up to a weight are given by edges(weight).

    If the edges up to some weight connect all nodes, their tree is the whole graph's, as no heavier edge can take
    the place of a lighter one; so the limit is doubled until they do, or all edges are there.
    """
    limit = first
    while True:
        found = stored(spanning_forest(edges(limit)), "tree")
        if limit >= last or found.count() >= nodes - 1:
            return found
        limit = min(2 * limit, last)


def random_tree(spark: SparkSession, nodes: int, seed: int = 0) -> DataFrame:
    """The minimum spanning tree of random_graph(); heavy edges, which it hardly needs, are made only if it does."""
    return tree_of(lambda most: random_graph(spark, nodes, seed, most), nodes, min(1.0, 4 * log2(max(nodes, 2)) / max(nodes, 2)), 1.0)


def euclidean_tree(points: DataFrame, axes: list[str], cell: float) -> DataFrame:
    """The minimum spanning tree of points (node, axes), by the pairs in neighbouring cells of a grid."""
    spread = points.agg(*[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    last = max(cell, 1.0001 * sqrt(sum(v * v for v in spread if v is not None)))
    return tree_of(lambda most: euclidean_graph(points, axes, most), points.count(), cell, last)


def linkage_clusters(points: DataFrame, axes: list[str], count: int, cell: float) -> DataFrame:
    """(node, cluster): single-linkage clusters, which the tree without its count - 1 heaviest edges connects; named by the smallest node."""
    tree = euclidean_tree(points, axes, cell)
    heavy = tree.orderBy(F.desc("w"), F.desc("a"), F.desc("b")).limit(count - 1)
    kept = stored(tree.join(heavy.select("a", "b"), ["a", "b"], "left_anti"), "kept")
    labels = stored(points.select("node", F.col("node").alias("cluster")), "labels")
    while True:  # the smallest label of a node and its neighbours, until nothing changes
        both = kept.select(F.col("a").alias("node"), F.col("b").alias("to")).union(kept.select("b", "a"))
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("cluster").alias("least"))
        moved = labels.join(near, "node", "left").select("node", F.least("cluster", "least").alias("to"), "cluster")
        jump = labels.select(F.col("node").alias("to"), F.col("cluster").alias("far"))
        new = stored(moved.join(jump, "to").select("node", "far", "cluster"), "labels")
        labels = new.select("node", F.col("far").alias("cluster"))
        if new.where("far <> cluster").isEmpty():
            return labels


def euclidean_graph(points: DataFrame, axes: list[str], cell: float) -> DataFrame:
    """Edges between points (node, axes) at most one cell's width apart, weighted by distance: pairs meet in neighbouring cells."""
    from itertools import product

    placed = points.select("node", *axes, *[F.floor(F.col(a) / cell).alias(f"c_{a}") for a in axes])
    steps = F.array(*[F.struct(*[F.lit(s).alias(f"s_{a}") for s, a in zip(move, axes)]) for move in product((-1, 0, 1), repeat=len(axes))])
    near = placed.withColumn("s", F.explode(steps)).select(F.col("node").alias("a"), *[F.col(x).alias(f"x_{x}") for x in axes], *[(F.col(f"c_{x}") + F.col(f"s.s_{x}")).alias(f"c_{x}") for x in axes])
    met = near.join(placed, [f"c_{x}" for x in axes]).where(F.col("a") < F.col("node"))
    squares = [F.pow(F.col(x) - F.col(f"x_{x}"), F.lit(2)) for x in axes]
    whole = squares[0]
    for s in squares[1:]:
        whole = whole + s
    return met.select("a", F.col("node").alias("b"), F.sqrt(whole).alias("w")).where(F.col("w") <= cell)
