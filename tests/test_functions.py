"""Functions against numpy and plain Python."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quern.functions import graphs, matrix, ml, prefix, tabular, text
from quern.sources import csvfile
from quern.sources.storage import numbered
from quern.streaming.ingest import appended


def test_prefix_sums_and_ranks_with_a_hot_group(spark):
    rows = [(i % 7 if i % 3 else 0, (i * 37) % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, o int, v long").repartition(9)
    got = prefix.running_total(df, ["o", "v"], F.col("v"), "run").collect()
    run = 0
    for r in sorted(got, key=lambda r: (r.o, r.v)):
        run += r.v
        assert r.run == run
    ranks = prefix.ranked(df, ["g"], ["o", "v"], "n").collect()
    by = {}
    for r in ranks:
        by.setdefault(r.g, []).append(r)
    for group in by.values():
        assert [r.n for r in sorted(group, key=lambda r: (r.o, r.v))] == list(range(1, len(group) + 1))
    assert sorted(r.place for r in numbered(df, "v", name="place").collect()) == list(range(3000))
    nulls = spark.createDataFrame([(None, 1), (None, 2), (1, 1)], "g int, o int")
    assert sorted((str(r.g), r.o, r.n) for r in prefix.ranked(nulls, ["g"], ["o"], "n").collect()) == [("1", 1, 1), ("None", 1, 1), ("None", 2, 2)]


def test_rank_sum_with_ties(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, 40), rng.integers(2, 14, 55)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("a", float("nan")), ("b", None)], "g string, v double")
    r = tabular.rank_sum(df, "v", "g", "a", "b").first()
    w = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (r.n1, r.n2, r.w) == (40, 55, pytest.approx(w)) and r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9)
    far = spark.range(1).select(*[tabular.two_sided(F.lit(z)).alias(f"p{i}") for i, z in enumerate((0.0, -1.96, 7.5, 20.0))]).first()
    assert list(far) == pytest.approx([math.erfc(z / math.sqrt(2)) for z in (0.0, 1.96, 7.5, 20.0)], rel=1e-7)


def test_regressions_and_classifiers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    label = (x @ [1.5, -2] + rng.normal(size=300) * 0.3 > 0).astype(int)
    kinds = np.where(x[:, 0] > 0.5, "c", np.where(x[:, 1] > 0, "b", "a"))
    df = spark.createDataFrame([(i, *map(float, v), int(y), str(k)) for i, (v, y, k) in enumerate(zip(x, label, kinds))], "id int, u double, v double, y int, k string")
    cols = [F.lit(1.0), F.col("u"), F.col("v")]
    full = np.c_[np.ones(300), x]
    assert np.allclose(ml.least_squares(df, cols, F.col("u") * 2 - F.col("v") + 1), [1, 2, -1])
    w = np.zeros(3)
    for _ in range(15):
        w = w - 0.5 * full.T @ (1 / (1 + np.exp(-full @ w)) - label) / 300
    assert np.allclose(ml.logistic_regression(df, cols, F.col("y"), 0.5, 15), w)
    s, hot = np.ones((3, 3)), np.array([[k == c for c in "abc"] for k in kinds], float)
    for _ in range(10):
        e = np.exp(full @ s.T)
        s = s - 0.01 * ((e / e.sum(axis=1, keepdims=True) - hot).T @ full + 0.1 * s)
    got = ml.softmax_regression(df, cols, F.col("k"), ["a", "b", "c"], 0.01, 10, 0.1)
    assert np.allclose(got, s)
    predicted = [r.p for r in df.orderBy("id").select(ml.softmax_class(cols, got, ["a", "b", "c"]).alias("p")).collect()]
    assert predicted == ["abc"[i] for i in (full @ s.T).argmax(axis=1)]
    for shared in (True, False):
        means = {k: x[kinds == k].mean(axis=0) for k in "abc"}
        covs = {k: np.cov(x[kinds == k].T, bias=True) for k in "abc"}
        pooled = sum(covs[k] * (kinds == k).mean() for k in "abc")
        score = []
        for k in "abc":
            c, d = pooled if shared else covs[k], x - means[k]
            score.append(np.log((kinds == k).mean()) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * (d @ np.linalg.inv(c) * d).sum(axis=1))
        rows = ml.gaussian_classify(df, "u", "v", "k", shared).orderBy("id").collect()
        assert [r.predicted for r in rows] == ["abc"[i] for i in np.array(score).argmax(axis=0)]


def test_mixture_components_and_decisions(spark):
    rng = np.random.default_rng(3)
    v = np.r_[rng.gamma(2, 1 / 0.5, 200), rng.gamma(2, 1 / 3, 100)]
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    theta, beta, seen = ml.gamma_mixture(df, "v", 2.0, [0.3, 2.0], 25)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and theta.sum() == pytest.approx(1) and sorted(beta)[0] < 1 < sorted(beta)[1]
    x = rng.normal(size=(200, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0.2, 0.1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    mean, parts, shares = ml.principal_components(df, cols, 2)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0))
    assert np.allclose(np.abs(parts), np.abs(vt[:2])) and np.allclose(shares, np.cumsum(s**2) / (s**2).sum())
    assert ml.reconstruction_error(df, cols, mean, parts).first()[0] == pytest.approx(s[2] ** 2 / 200)
    moves = [(0, 0, 0, 1.0, 1.0), (0, 1, 1, 1.0, 0.0), (1, 0, 1, 0.5, 3.0), (1, 0, 0, 0.5, 0.0), (1, 1, 0, 1.0, 1.0)]
    frame = spark.createDataFrame(moves, "state int, action int, to int, p double, reward double")
    values, policy = ml.value_iteration(frame, 2, 0.9)
    exact, same = ml.policy_iteration(frame, 2, 0.9)
    assert np.allclose(values, exact, atol=1e-6) and list(policy) == list(same) == [0, 0]
    found = ml.arrivals(spark, 4000, 2.0, 3.0).first()
    assert tuple(ml.arrivals(spark, 4000, 2.0, 3.0, block=3).first()) == pytest.approx(tuple(found))  # no gap is left out
    assert found["mean"] == pytest.approx(6, abs=0.3) and found.sd == pytest.approx(6**0.5, abs=0.3)


def kruskal(edges):
    root, total, picked = {}, 0.0, 0

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        x, y = top(a), top(b)
        if x != y:
            root[x], total, picked = y, total + w, picked + 1
    return picked, total


def test_spanning_forests(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(0, 9, 150)) if a != b] + [(100, 101, 2.0), (5, 5, 1.0)]
    for few in (0, None):
        got = graphs.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"), few=few).collect()
        assert (len(got), sum(r.w for r in got)) == kruskal(edges[:-1])
    whole = graphs.random_graph(spark, 80, seed=2)
    rows = [tuple(r) for r in whole.collect()]
    assert len(rows) == len({r[:2] for r in rows}) == 80 * 79 // 2 and all(0 <= a < b < 80 for a, b, _ in rows)
    tree = graphs.random_tree(spark, 80, seed=2).collect()
    n, total = kruskal(rows)
    assert len(tree) == n == 79 and sum(r.w for r in tree) == pytest.approx(total)
    assert graphs.spanning_forest(whole.limit(0)).count() == 0 and graphs.spanning_forest(whole.limit(0), few=-1).count() == 0


def test_trees_that_the_first_edges_do_not_connect(spark):
    """Far groups of points: short edges alone give several trees, so longer ones are made until one is left."""
    points = [(i, 100.0 * (i % 2) + i / 50, float(i % 3)) for i in range(24)]
    frame = spark.createDataFrame(points, "node long, x double, y double")
    tree = graphs.euclidean_tree(frame, ["x", "y"], 40.0).collect()
    pairs = [(a, b, math.dist(p, q)) for a, *p in points for b, *q in points if a < b]
    assert (len(tree), pytest.approx(sum(r.w for r in tree))) == kruskal(pairs)
    assert {r.cluster for r in graphs.linkage_clusters(frame, ["x", "y"], 2, 120.0).collect()} == {0, 1}


def test_medians_of_many_values(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(None if i % 9 == 0 else i % 4, float(rng.integers(0, 60)) if i % 13 else None) for i in range(700)] + [(7, None), (8, 2.5), (8, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double")
    want = {str(r.g): r.m for r in tabular.medians(df, "v", "g", name="m").collect()}
    monkeypatch.setattr(tabular, "FEW_VALUES", 1)
    assert {str(r.g): r.m for r in tabular.medians(df, "v", "g", name="m").collect()} == want
    kept = sorted(v for _, v in rows if v is not None and v == v)
    assert tabular.medians(df, "v").first()[0] == np.median(kept) and tabular.medians(df.limit(0), "v", "g").count() == 0
    assert [want["8"], want["7"]] == [2.5, None]


def test_networks_clusters_and_q_values(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no line tells them apart
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    layers = ml.perceptron(df, [F.col("a"), F.col("b")], F.col("y"), 2, 12, 1.0, 110)
    assert df.agg(F.avg((ml.perceptron_class([F.col("a"), F.col("b")], layers) == F.col("y")).cast("int"))).first()[0] > 0.9
    centres = ml.clusters(df, ["a", "b"], [[-1, 0], [1, 0], [50, 50]], 3)
    assert centres[2].tolist() == [50, 50] and centres[0][0] < 0 < centres[1][0]
    moves = spark.createDataFrame([(0, 0, 1.0, 1), (0, 1, 0.0, 0), (1, 0, 5.0, None), (1, 0, 7.0, None)], "state int, action int, reward double, to int")
    q = ml.q_values(moves, 2, 2, 0.5, 1.0, 30)
    assert np.allclose(q, [[4.0, 2.0], [6.0, 0.0]])


def test_matrices_and_texts(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(-3, 4, (9, 7)), rng.integers(-3, 4, (7, 8))
    rows = lambda m: spark.createDataFrame([(i, j, int(m[i, j])) for i, j in zip(*m.nonzero())] and [(int(i), int(j), int(m[i, j])) for i, j in zip(*m.nonzero())], "i int, j int, v long")
    for got in (matrix.multiply(rows(a), rows(b)), matrix.multiply_blocked(rows(a), rows(b), 3)):
        out = np.zeros((9, 8), int)
        for r in got.collect():
            out[r.i, r.j] = r.v
        assert (out == a @ b).all()
    docs = spark.createDataFrame([("a b\n c\n",), ("",), (None,), ("é  x",)], "t string")
    counts = docs.select(*[c.alias(k) for k, c in text.counts("t").items()]).collect()
    assert [tuple(r) for r in counts] == [(2, 3, 7), (0, 0, 0), (0, 0, 0), (0, 2, 5)]


def test_delimited_files_and_incremental_loading(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("word\tduration\nnot\t1.5\nknot\tNA\n")
    df = csvfile.read_delimited(spark, str(path), "word string, duration double")
    assert [tuple(r) for r in tabular.means(df, "duration").collect()] == [(1.5,)]
    path.write_text("# year, t\n1.0, 2.0\n")
    assert csvfile.read_delimited(spark, str(path), "y double, t double", sep=",", comment="#", header_line=False).count() == 1
    folder = tmp_path / "in"
    folder.mkdir()
    schema = StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])
    for i in range(3):
        (folder / f"{i}.csv").write_text(f"a,b\n{i}, {i * i}\n{i + 10},7")
        table = appended(spark, str(folder), schema, str(tmp_path / "table"), str(tmp_path / "check"))
        assert table.count() == 2 * (i + 1)


def test_nearest_rows_as_all_pairs_order_them(spark, monkeypatch):
    """Many rows at one place, ties by key, few rows, no number, several pieces and blocks: as a sort of all pairs."""
    rng = np.random.default_rng(7)
    data = [(int(i), float(rng.integers(0, 40)) / 8 if i % 3 else 2.0, int(rng.integers(0, 6))) for i in rng.permutation(900)] + [(901, float("nan"), 1), (902, None, 1)]
    asked = [(i, float(rng.integers(-8, 60)) / 8, int(rng.integers(0, 6))) for i in range(70)] + [(70, float("nan"), 2)]
    for most, rows in ((900, data), (100, data), (100, data[:3])):
        monkeypatch.setattr(ml, "PIECE_ROWS", most)
        monkeypatch.setattr(ml, "LOOKUP_BLOCK", most)
        want = []
        for q, x, y in asked:
            near = sorted((math.inf if math.isnan(d := (v - x) ** 2 + (w - y) ** 2 / 9.0) else d, i) for i, v, w in rows if v is not None)[:5]
            want += [(q, i) for _, i in near]
        df = spark.createDataFrame(rows, "id int, v double, w int").repartition(3)
        got = ml.nearest(df, spark.createDataFrame(asked, "q int, x double, y int"), {"v": ("x", 1.0), "w": ("y", 9.0)}, "id", "q", 5)
        assert sorted((r.q, r.id) for r in got.collect()) == sorted(want)


def test_neighbours_are_not_sought_among_all_pairs():
    """A window around a query, not all places, is what is looked at."""
    rng = np.random.default_rng(8)
    places, queries = rng.uniform(0, 1e4, (2, 300_000)), rng.uniform(0, 1e4, (2, 2_000))
    places[1], queries[1] = places[1] // 400, queries[1] // 400
    began = time.process_time()
    found, _ = ml._closest(queries, places, np.arange(300_000), [1.0, 9.0], 5)
    assert time.process_time() - began < 2  # all pairs take over ten
    for i in range(0, 2_000, 200):
        d = (places[0] - queries[0, i]) ** 2 + (places[1] - queries[1, i]) ** 2 / 9.0
        assert found[i].tolist() == np.argsort(d, kind="stable")[:5].tolist()
