"""Decontamination against brute force, proximity by hand, defined cases."""

import random
import re
import time

from pyspark.sql import functions as F

from quern.llm import positions

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    phrases = {}
    for item, text in items:
        ws = words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1) if ws else ():
            phrases.setdefault(tuple(ws[i : i + n]), set()).update([] if item is None else [str(item)])
    lengths = {len(p) for p in phrases}
    for _, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                if (got := phrases.get(tuple(ws[i : i + n]))) is not None:
                    found |= got
                    hit |= set(range(i, i + n))
        yield len(ws), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws)


def compare(spark, docs, items, **options):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = positions.contamination(d, b, **options).sort("uid").collect()
    want = sorted((str(k), *x) for (k, _), x in zip(docs, brute(docs, items)))
    assert sorted((str(r.key), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == want


def test_documents_as_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    compare(spark, rows, items)


def test_defined_cases(spark):
    long = " ".join(str(i % 50) for i in range(70_000)) + " one two three"
    docs = [(1, None), (2, ""), (3, "?!"), (None, "ONE two--three"), (5, "a b a b a b"), (5, "a b a b a b"), (7, long), (8, "é É é")]
    items = [(1, "one two three"), (1, "one two three"), (2, None), (3, "..."), (4, "b a"), (None, "a"), (6, "49 0 1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (7, "é")]
    compare(spark, docs, items)
    compare(spark, docs, items, window=2)
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert positions.contamination(d.limit(0), b).count() == 0
    assert not positions.contamination(d, b.limit(0)).where("n_hit > 0").count()
    kept = positions.clean(d.withColumn("uid", F.lit("clash")).withColumn("Hash", F.lit(1)), b)
    assert kept.columns == [*d.columns, "uid", "Hash"] and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3"]


def test_blocks_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x a q b q c x"), (2, "a q q q q q b c"), (3, "c b"), (4, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "q b")], "item_id long, text string")
    index = positions.build(docs)
    key = {r.uid: r.key for r in positions.documents(index).collect()}
    near = {(key[r.uid], r["item"], r.start, r.end) for r in positions.matches(index, items, distance=4, block_words=1).collect()}
    assert near == {("1", "1", 1, 6), ("1", "2", 2, 4), ("2", "2", 5, 7)}
    exact = {(key[r.uid], r["item"], r.start, r.end) for r in positions.matches(index, items, window=None, block_words=1).collect()}
    assert exact == {("1", "2", 2, 4), ("2", "2", 5, 7)}


def test_phrases_that_occur_nowhere_cost_nothing(spark, monkeypatch):
    """Only phrases all of whose terms are in the index are anchored, and a segment looks at those of its own anchors."""
    rng = random.Random(3)
    known = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(known, k=2000))) for i in range(60)], "doc_id long, text string")
    index, took = positions.build(docs), {}
    for n in (1000, 5000):
        items = spark.createDataFrame([(i, " ".join([*rng.choices(known, k=12), f"new{i}"])) for i in range(n)], "item_id long, text string")
        assert positions.anchored(index, positions.phrases(items, "item_id", "text", 13)).count() == 0
        began = time.perf_counter()
        assert positions.matches(index, items).count() == 0
        took[n] = time.perf_counter() - began
    assert took[5000] < 3 * took[1000] + 2
