"""Regression, classification, mixtures and small decision processes; large tables are only summed, models are small."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.errors import QuernError
from quern.sources.storage import stored

#: Rows of a query set that may be sent to every task; larger ones are dealt in blocks of this size.
QUERY_BLOCK = 20_000
#: The same where neighbours are looked up, and rows that a task looks them up among at a time.
LOOKUP_BLOCK, PIECE_ROWS = 1 << 16, 1 << 20


def _squared(pairs: Sequence[tuple[Column, Column, float]]) -> Column:
    whole = F.lit(0.0)
    for a, b, weight in pairs:
        whole = whole + (a - b) * (a - b) * weight
    return whole


def _blocks(queries: DataFrame, most: int) -> Iterator[pa.Table]:
    """The queries in tables of at most about so many rows, one after the other."""
    n = queries.count()
    blocks = max(1, -(-n // most))
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)) == i)
        yield part.toArrow()


def _passes(data: DataFrame, queries: DataFrame, run: Callable, schema: str | StructType, most: int | None = None) -> DataFrame:
    """run(batches, block) over the data for each block of queries; beyond one, a block's rows are stored before the next is sent."""
    out = None
    for block in _blocks(queries, most or QUERY_BLOCK):
        found = data.mapInArrow(partial(run, block=block), schema)
        if out is None:
            out = found
            continue
        out = out.union(stored(found, "block"))
    return out


def kernel_regression(data: DataFrame, queries: DataFrame, x: str, y: str, at: str, tau: float) -> DataFrame:
    """(at, estimate): means of y weighted by exp(-(distance squared) / tau); tasks send two sums for each query."""

    def run(batches, block):
        places = block.column("at").to_numpy(zero_copy_only=False)
        total = np.zeros((2, len(places)))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                u, v = (batch.column(i).slice(start, 1024).to_numpy(zero_copy_only=False) for i in range(2))
                weight = np.exp(-((u - places[:, None]) ** 2) / tau)
                total += weight @ v, weight.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[0]), pa.array(total[1])], names=["at", "top", "low"])

    rows = data.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double"), F.col(y).cast("double"))
    wanted = queries.select(F.col(at).cast("double").alias("at")).where("at is not null").distinct()
    sums = _passes(rows, wanted, run, "at double, top double, low double")
    return sums.groupBy(F.col("at").alias(at)).agg((F.sum("top") / F.sum("low")).alias("estimate"))


def _least_keys(rows: pa.Table, places: np.ndarray, key: str, k: int) -> np.ndarray:
    """Numbers of the rows that can be near: of those at one place, the k with the smallest keys; in the order of places, then keys."""
    by_key = pc.sort_indices(rows.column(key)).to_numpy()
    order = by_key[np.lexsort(places[::-1, by_key])]
    new = np.r_[True, (places[:, order[1:]] != places[:, order[:-1]]).any(axis=0)]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


def _closest(queries: np.ndarray, places: np.ndarray, ranks: np.ndarray, scales: Sequence[float], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of a place, distance) of the k nearest of each query, or all if there are fewer; equals by the smaller rank.

    Places are looked up along the axis on which they lie widest apart: a window of them around the query holds the
    nearest once what lies outside of it is further on this axis alone.  Until then the window is doubled.
    """
    n, k = places.shape[1], min(k, places.shape[1])
    main = int(np.argmax([len(np.unique(p)) for p in places]))
    order = np.argsort(places[main], kind="stable")
    places, ranks, line = places[:, order], ranks[order], places[main, order]
    found, distance = np.empty((queries.shape[1], k), np.int64), np.empty((queries.shape[1], k))
    todo, width = np.arange(queries.shape[1]), min(n, max(64, 4 * k))
    centre = np.searchsorted(line, queries[main])
    while len(todo):
        unsettled = []
        step = max(1, (1 << 19) // width)
        for at in range(0, len(todo), step):
            who = todo[at : at + step]
            first = np.clip(centre[who] - width // 2, 0, n - width)
            near = first[:, None] + np.arange(width)
            d = np.zeros(near.shape)
            for q, p, s in zip(queries, places, scales):
                d += (p[near] - q[who, None]) ** 2 / s
            best = np.lexsort((ranks[near], d), axis=1)[:, :k]
            d = np.take_along_axis(d, best, axis=1)
            q, s = queries[main, who], scales[main]
            below = np.where(first > 0, (line[first - 1] - q) ** 2 / s, np.inf)
            above = np.where(first + width < n, (line[np.minimum(first + width, n - 1)] - q) ** 2 / s, np.inf)
            # NaN is further than all, and only the whole line tells which of it is near
            done = (~(below <= d[:, -1]) & ~(above <= d[:, -1]) & ~np.isnan(d[:, -1])) | (width == n)
            found[who[done]] = order[np.take_along_axis(near, best, axis=1)[done]]
            distance[who[done]] = d[done]
            unsettled.append(who[~done])
        todo, width = np.concatenate(unsettled), min(n, 2 * width)
    return found, distance


def nearest(data: DataFrame, queries: DataFrame, axes: dict[str, tuple[str, float]], key: str, query: str, k: int) -> DataFrame:
    """The k nearest rows of each query beside it: axes maps a data column to a query column and a scale, by which the
    square of the difference is divided; ties go to the smaller key.

    Tasks gather their rows in pieces, keep what can be near at each place, and look a block of queries up in them;
    each keeps k rows for a query over all its pieces, so no pairs are made but those.  Rows without a place are near to
    nothing.
    """
    names, scales, most = [b for b, _ in axes.values()], [s for _, s in axes.values()], PIECE_ROWS

    def place(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
        return np.stack([rows.column(c).cast(pa.float64()).to_numpy() for c in columns]) + 0.0  # one zero

    def run(batches, block):
        wanted = place(block, names)
        best, whose, d = None, np.zeros(0, np.int64), np.zeros(0)
        for piece in _pieces(batches, most):
            own = place(piece, list(axes))
            kept = _least_keys(piece, own, key, k)
            piece, own = piece.take(pa.array(kept)), own[:, kept]
            ranks = np.empty(len(kept), np.int64)
            ranks[pc.sort_indices(piece.column(key)).to_numpy()] = np.arange(len(kept))
            found, distance = _closest(wanted, own, ranks, scales, k)
            rows, asked = piece.take(pa.array(found.ravel())), np.repeat(np.arange(block.num_rows), found.shape[1])
            if best is None:
                best, whose, d = rows, asked, distance.ravel()
                continue
            rows, whose, d = pa.concat_tables([best, rows]), np.r_[whose, asked], np.r_[d, distance.ravel()]
            ranks = np.empty(len(d), np.int64)
            ranks[pc.sort_indices(rows.column(key)).to_numpy()] = np.arange(len(d))
            order = np.lexsort((ranks, d, whose))
            firsts = np.searchsorted(whose[order], np.arange(block.num_rows))
            order = order[np.arange(len(order)) - firsts[whose[order]] < k]
            best, whose, d = rows.take(pa.array(order)), whose[order], d[order]
        if best is not None:
            asked = block.take(pa.array(whose))
            found = pa.table([*best.columns, *asked.columns, pa.array(d)], names=schema.names)
            yield from found.combine_chunks().to_batches(max_chunksize=1 << 16)

    there = F.lit(True)
    for a in axes:
        there = there & F.col(a).isNotNull()
    schema = StructType([*data.schema.fields, *queries.schema.fields, StructField("__d", DoubleType())])
    asked = queries
    for b in names:
        asked = asked.where(F.col(b).isNotNull())
    pairs = _passes(data.where(there), asked, run, schema, LOOKUP_BLOCK)
    rank = F.row_number().over(Window.partitionBy(query).orderBy("__d", key))
    return pairs.withColumn("__rank", rank).where(F.col("__rank") <= k)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of about `most` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def knn_regression(data: DataFrame, queries: DataFrame, x: str, y: str, key: str, at: str, k: int) -> DataFrame:
    """(at, estimate): the mean of the k nearest rows' y."""
    return nearest(data.select(key, x, y), queries.select(at), {x: (at, 1.0)}, key, at, k).groupBy(at).agg(F.avg(y).alias("estimate"))


def knn_votes(data: DataFrame, queries: DataFrame, axes: dict[str, tuple[str, float]], label: str, key: str, query: str, k: int) -> DataFrame:
    """(query, label, share): how the k nearest rows vote."""
    found = nearest(data, queries, axes, key, query, k)
    return found.groupBy(query, label).agg((F.count("*") / k).alias("share"))


def knn_classify(data: DataFrame, queries: DataFrame, axes: dict[str, tuple[str, float]], label: str, key: str, query: str, k: int) -> DataFrame:
    """(query, predicted): the label with most votes, the smaller of equals."""
    votes = knn_votes(data, queries, axes, label, key, query, k)
    return votes.groupBy(query).agg(F.min_by(label, F.struct(-F.col("share"), F.col(label))).alias("predicted"))


@dataclass(frozen=True)
class Basis:
    """A set of functions of x / scale beside 1: powers, bumps exp(-(x - centre)^2 / width), or cosines of x / j."""

    kind: str
    scale: float
    degrees: tuple[int, ...]
    offset: float = 0.0
    step: float = 1.0
    width: float = 1.0


#: The four expansions of a size in thousands, and those of years and plain numbers.
BASES = {
    "a": Basis("powers", 181.0, tuple(range(1, 10))),
    "b": Basis("bumps", 400.0, tuple(range(1, 10)), offset=7.0, step=8.0, width=5.0),
    "c": Basis("cosines", 1.81, tuple(range(1, 10))),
    "d": Basis("cosines", 0.181, tuple(range(1, 50))),
    "powers": Basis("powers", 1.0, tuple(range(1, 6))),
    "years": Basis("bumps", 1.0, tuple(range(0, 11)), offset=392.0, step=0.2, width=25.0),
    "cosines": Basis("cosines", 1.0, tuple(range(1, 6))),
}


def basis(x: Column, named: str | Basis) -> list[Column]:
    """Columns of an expansion; the centre of bump j is (j + offset) / step."""
    if isinstance(named, str):
        if named not in BASES:
            raise QuernError(f"unknown basis {named}")
        named = BASES[named]
    v = x / named.scale
    make = {
        "powers": lambda j: F.pow(v, F.lit(j)),
        "bumps": lambda j: F.exp(-(v - (j + named.offset) / named.step) * (v - (j + named.offset) / named.step) / named.width),
        "cosines": lambda j: F.cos(v / j),
    }
    if named.kind not in make:
        raise QuernError(f"unknown basis {named.kind}")
    return [F.lit(1.0), *[make[named.kind](j) for j in named.degrees]]


def gram(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """Sums of products of all pairs of columns, in one pass."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = df.agg(*[F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((n, n))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v or 0.0
    return out


def least_squares(df: DataFrame, features: Sequence[Column], y: Column) -> np.ndarray:
    """Weights of the normal equations; the pseudo-inverse settles columns that depend on each other."""
    sums = gram(df, [*features, y])
    return np.linalg.pinv(sums[:-1, :-1]) @ sums[:-1, -1]


def linear(features: Sequence[Column], weights: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for f, w in zip(features, weights):
        out = out + f * float(w)
    return out


def mean_squared_error(df: DataFrame, y: Column, predicted: Column) -> DataFrame:
    return df.agg(F.avg((y - predicted) * (y - predicted)).alias("mse"))


def logistic_regression(df: DataFrame, features: Sequence[Column], y: Column, rate: float, rounds: int, start: Sequence[float] | None = None) -> np.ndarray:
    """Batch gradient descent on the mean loss; each round is one aggregation."""
    w = np.zeros(len(features)) if start is None else np.array(start, float)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-linear(features, w)))
        row = df.agg(*[F.avg((p - y) * f).alias(f"g{i}") for i, f in enumerate(features)]).first()
        w = w - rate * np.array([v or 0.0 for v in row])
    return w


def softmax_regression(df: DataFrame, features: Sequence[Column], label: Column, classes: Sequence, rate: float, rounds: int, l2: float) -> np.ndarray:
    """[class, feature] weights of multinomial regression with an L2 penalty, by batch gradient descent on sums, from ones."""
    w = np.ones((len(classes), len(features)))
    for _ in range(rounds):
        scores = [F.exp(linear(features, row)) for row in w]
        total = scores[0]
        for s in scores[1:]:
            total = total + s
        parts = [F.sum((s / total - (label == c).cast("double")) * f).alias(f"g{i}_{j}") for i, (s, c) in enumerate(zip(scores, classes)) for j, f in enumerate(features)]
        grad = np.array([v or 0.0 for v in df.agg(*parts).first()]).reshape(w.shape)
        w = w - rate * (grad + l2 * w)
    return w


def softmax_class(features: Sequence[Column], weights: np.ndarray, classes: Sequence) -> Column:
    """The class of the greatest score, the first of equals."""
    best = F.greatest(*[F.struct(linear(features, row).alias("s"), F.lit(-i).alias("i")) for i, row in enumerate(weights)])
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.lit(1) - best["i"])


def gaussian_parameters(df: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """(label, n, prior, mean_x, mean_y, var_x, var_y, cov): what a Gaussian generative classifier learns."""
    total = df.agg(F.count("*").alias("__n"))
    groups = df.groupBy(label).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.var_pop(x).alias("var_x"), F.var_pop(y).alias("var_y"), F.covar_pop(x, y).alias("cov"),
    )
    return groups.join(F.broadcast(total)).withColumn("prior", F.col("n") / F.col("__n")).drop("__n")


def gaussian_classify(df: DataFrame, x: str, y: str, label: str, shared: bool, name: str = "predicted") -> DataFrame:
    """df with the class of the greatest posterior; parameters of a class are a few numbers, gathered by the driver."""
    rows = gaussian_parameters(df, x, y, label).orderBy(label).collect()
    n = sum(r.n for r in rows)
    pooled = [sum(r[f] * r.n for r in rows) / n for f in ("var_x", "var_y", "cov")]
    scores = []
    for i, r in enumerate(rows):
        vx, vy, c = pooled if shared else (r.var_x, r.var_y, r.cov)
        det = vx * vy - c * c
        dx, dy = F.col(x) - r.mean_x, F.col(y) - r.mean_y
        distance = (dx * dx * vy - dx * dy * (2 * c) + dy * dy * vx) / det
        scores.append(F.struct((F.lit(float(np.log(r.prior) - 0.5 * np.log(det))) - distance / 2).alias("s"), F.lit(-i).alias("i")))
    best = F.greatest(*scores)
    return df.withColumn(name, F.element_at(F.array(*[F.lit(r[label]) for r in rows]), F.lit(1) - best["i"]))


def gamma_mixture(df: DataFrame, x: str, alpha: float, rates: Sequence[float], rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(weights, rates, log-likelihoods) of a mixture of Gamma(alpha, rate) by EM; each round is one aggregation."""
    from math import lgamma

    beta, theta, seen = np.array(rates, float), np.full(len(rates), 1 / len(rates)), []
    v = F.col(x)
    for _ in range(rounds):
        logs = [F.lit(float(np.log(t) + alpha * np.log(b) - lgamma(alpha))) + F.log(v) * (alpha - 1) - v * float(b) for t, b in zip(theta, beta)]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        parts = [F.exp(e - top) for e in logs]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        row = df.agg(F.count("*"), F.sum(top + F.log(total)), *[f(p / total * w) for p in parts for f, w in ((F.sum, F.lit(1.0)), (F.sum, v))]).first()
        n, likelihood, sums = row[0], row[1], np.array(row[2:], float).reshape(-1, 2)
        seen.append(likelihood)
        theta, beta = sums[:, 0] / n, alpha * sums[:, 0] / sums[:, 1]
    return theta, beta, seen


def principal_components(df: DataFrame, columns: Sequence[Column], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, [k, column] components with a positive greatest entry, cumulative shares of variance)."""
    sums = gram(df, [F.lit(1.0), *columns])
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    values, vectors = np.linalg.eigh(sums[1:, 1:] / n - np.outer(mean, mean))
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return mean, vectors[:k], np.cumsum(values) / values.sum()


def reconstruction_error(df: DataFrame, columns: Sequence[Column], mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """The mean squared distance of rows to their projection on the components."""
    centred = [c - float(m) for c, m in zip(columns, mean)]
    total = linear([c * c for c in centred], np.ones(len(centred)))
    for row in components:
        along = linear(centred, row)
        total = total - along * along
    return df.agg(F.avg(total).alias("error"))


def value_iteration(transitions: DataFrame, states: int, gamma: float, tolerance: float = 1e-9, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(values, policy) of a decision process given as rows (state, action, to, p, reward); states are few by nature."""
    rows = transitions.groupBy("state", "action", "to").agg(F.sum("p").alias("p"), F.sum(F.col("p") * F.col("reward")).alias("r")).collect()
    actions = 1 + max(r.action for r in rows)
    p, reward = np.zeros((states, actions, states)), np.full((states, actions), -np.inf)
    for r in rows:
        p[r.state, r.action, r.to] += r.p
        reward[r.state, r.action] = (0 if reward[r.state, r.action] == -np.inf else reward[r.state, r.action]) + r.r
    v = np.zeros(states)
    for _ in range(most):
        q = reward + gamma * p @ v
        new = q.max(axis=1)
        if np.abs(new - v).max() < tolerance:
            break
        v = new
    return new, q.argmax(axis=1)


def policy_iteration(transitions: DataFrame, states: int, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, policy), by solving each policy's equations until it is its own best answer."""
    rows = transitions.groupBy("state", "action", "to").agg(F.sum("p").alias("p"), F.sum(F.col("p") * F.col("reward")).alias("r")).collect()
    actions = 1 + max(r.action for r in rows)
    p, reward, there = np.zeros((states, actions, states)), np.zeros((states, actions)), np.zeros((states, actions), bool)
    for r in rows:
        p[r.state, r.action, r.to] += r.p
        reward[r.state, r.action] += r.r
        there[r.state, r.action] = True
    policy = there.argmax(axis=1)
    while True:
        own = np.arange(states)
        v = np.linalg.solve(np.eye(states) - gamma * p[own, policy], reward[own, policy])
        q = np.where(there, reward + gamma * p @ v, -np.inf)
        better = np.where(q.max(axis=1) > q[own, policy] + 1e-12, q.argmax(axis=1), policy)
        if (better == policy).all():
            return v, policy
        policy = better


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of some values, the same in every engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def arrivals(spark, trials: int, rate: float, horizon: float, block: int = 40, seed: int = 0) -> DataFrame:
    """(mean, sd) of the number of Poisson arrivals before a horizon, by seeded simulation of gaps.

    Gaps are drawn in blocks; trials that a block leaves before the horizon go on with the next, until none is.
    """
    open_ = spark.range(trials).select("id", F.lit(0.0).alias("t"), F.lit(0).alias("n"))
    done, first = None, 0
    while True:
        gaps = F.array(*[-F.log(uniform(F.col("id"), F.lit(first + i), F.lit(seed))) / rate for i in range(block)])
        step = lambda a, g: F.struct((a["t"] + g).alias("t"), (a["n"] + F.when(a["t"] + g <= horizon, 1).otherwise(0)).alias("n"))
        state = F.aggregate(gaps, F.struct(F.col("t"), F.col("n")), step)
        ran = stored(open_.select("id", state.alias("s")).select("id", "s.t", "s.n"), "trials")
        ended = ran.where(F.col("t") > horizon).select("n")
        done = ended if done is None else done.union(ended)
        open_, first = ran.where(F.col("t") <= horizon), first + block
        if open_.isEmpty():
            return done.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))


def clusters(df: DataFrame, axes: Sequence[str], start: Sequence[Sequence[float]], rounds: int) -> np.ndarray:
    """[cluster, axis] centres of k-means by Lloyd's rounds from given centres; each round is one aggregation, empty clusters stay."""
    centres = np.array(start, float)
    for _ in range(rounds):
        own = nearest_centre(axes, centres)
        rows = df.groupBy(own.alias("c")).agg(*[F.avg(a).alias(f"m{i}") for i, a in enumerate(axes)]).collect()
        for r in rows:
            centres[r.c] = [r[f"m{i}"] for i in range(len(axes))]
    return centres


def nearest_centre(axes: Sequence[str], centres: np.ndarray) -> Column:
    """The number of the nearest centre, the first of equals."""
    best = F.least(*[F.struct(_squared([(F.col(a), F.lit(float(v)), 1.0) for a, v in zip(axes, c)]).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return best["i"]


def perceptron(df: DataFrame, features: Sequence[Column], label: Column, classes: int, hidden: int, rate: float, rounds: int, seed: int = 0) -> list[np.ndarray]:
    """Weights of a network with one layer of rectified units and a softmax, by gradient descent on the mean cross-entropy.

    Each round is one pass: tasks turn batches into sums of gradients, a row each, which Spark adds up.  Labels are
    numbers from 0; the model is small by nature.  The last column of each layer's input is 1.
    """
    rng, width = np.random.default_rng(seed), len(features)
    layers = [rng.normal(0, 1 / np.sqrt(width), (width + 1, hidden)), rng.normal(0, 1 / np.sqrt(hidden), (hidden + 1, classes))]
    rows = df.select(*[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)], label.cast("int").alias("y"))

    def run(batches, layers):
        total = [np.zeros_like(w) for w in layers]
        n = 0
        for batch in batches:
            x = np.column_stack([*[batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], np.ones(batch.num_rows)])
            y = batch.column(width).to_numpy(zero_copy_only=False)
            middle = np.column_stack([np.maximum(x @ layers[0], 0), np.ones(len(x))])
            off = softmax(middle @ layers[1])
            off[np.arange(len(y)), y] -= 1
            back = (off @ layers[1][:-1].T) * (middle[:, :-1] > 0)
            total = [total[0] + x.T @ back, total[1] + middle.T @ off]
            n += len(y)
        flat = np.r_[total[0].ravel(), total[1].ravel(), n]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    for _ in range(rounds):
        flat = np.zeros(sum(w.size for w in layers) + 1)
        for r in rows.mapInArrow(partial(run, layers=layers), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r.i] = r.v
        cut = layers[0].size
        grads = [flat[:cut].reshape(layers[0].shape), flat[cut:-1].reshape(layers[1].shape)]
        layers = [w - rate * g / max(flat[-1], 1) for w, g in zip(layers, grads)]
    return layers


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def perceptron_class(features: Sequence[Column], layers: Sequence[np.ndarray]) -> Column:
    """The number of the greatest output, the first of equals."""
    middle = [F.greatest(linear([*features, F.lit(1.0)], column), F.lit(0.0)) for column in layers[0].T]
    best = F.greatest(*[F.struct(linear([*middle, F.lit(1.0)], column).alias("s"), F.lit(-i).alias("i")) for i, column in enumerate(layers[1].T)])
    return -best["i"]


def q_values(transitions: DataFrame, states: int, actions: int, gamma: float, rate: float, rounds: int) -> np.ndarray:
    """[state, action] values of Q-learning on recorded transitions (state, action, reward, to; no `to` ends a run).

    Each round moves every pair by the mean of its transitions' errors, as one aggregation; pairs never seen stay 0.
    """
    q = np.zeros((states, actions))
    rows = transitions.groupBy("state", "action", "to").agg(F.count("*").alias("n"), F.sum("reward").alias("r"))
    rows = stored(rows, "moves")  # at most states x actions x states rows
    for _ in range(rounds):
        best = F.element_at(F.array(*[F.lit(float(v)) for v in q.max(axis=1)]), F.col("to") + 1)
        target = F.col("r") + gamma * F.col("n") * F.coalesce(F.when(F.col("to").isNotNull(), best), F.lit(0.0))
        for r in rows.groupBy("state", "action").agg((F.sum(target) / F.sum("n")).alias("v")).collect():
            q[r.state, r.action] += rate * (r.v - q[r.state, r.action])
    return q
