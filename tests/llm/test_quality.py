"""Quality: held-out accuracy, votes by hand, defined cases."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import quality
from quern.llm.common import crc_mod


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels, fold = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), crc_mod("doc_id", 5)
    model = quality.fit(docs, labels, train=fold != 0)
    held = quality.score(docs.join(labels, "doc_id").where(fold == 0).select("text", "quality"), model).collect()
    right = np.mean([(r.score >= 0.3) == r.quality for r in held])
    caught = np.mean([r.score < 0.3 for r in held if not r.quality])
    assert right > 0.97 and caught > 0.85 and len(model.labels) <= 1.1 * quality.SAMPLE


def plain_vector(model, text):
    """Dense and step by step, from the terms on: columns, weights of the two kinds, axes."""
    counts = {}
    for term, n in quality.terms(text).items():
        at = zlib.crc32(term) % quality.COLUMNS
        counts[at] = counts.get(at, 0) + math.log(1 + n)
    words = (text or "").encode().lower().split()
    for word in set(words):
        at = quality.COLUMNS + zlib.crc32(word) % quality.WORDS
        counts[at] = counts.get(at, 0) + math.log(1 + words.count(word))
    row = np.zeros(quality.COLUMNS + quality.WORDS)
    for at, v in counts.items():
        row[at] = v * model.inverse[at]
    for part, share in ((row[: quality.COLUMNS], 1), (row[quality.COLUMNS :], quality.WORD_SHARE)):
        part *= share / max(math.sqrt(sum(part**2)), 1e-9)
    x = np.rint(row * 2**15) @ model.axes
    return np.rint(x * (2**14 / max(math.sqrt(sum(x**2)), 1e-9)))


def test_votes_as_all_neighbours_and_alone_as_in_blocks(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, neighbours=7)
    texts = [r.text for r in docs.select("text").collect()]
    every, seen = quality.document_frequencies(docs, "text")
    assert every == len(texts) and all(seen[c] == sum(c in quality.hashed(t)[0] for t in texts) for c in range(0, len(seen), 500))
    got = model.scores(texts)
    assert list(got) == [model.scores([t])[0] for t in texts] and list(model.scores(texts[::-1])) == list(got[::-1])
    for text, score in list(zip(texts, got))[::9]:
        steps = [int(x) for x in model.vectors @ plain_vector(model, text)]
        near = sorted(range(len(steps)), key=lambda i: (-steps[i], i))[:7]
        weights = [math.exp(quality.SHARP * (steps[i] / 2**28 - 1)) for i in near]
        assert abs(score - sum(w * model.labels[i] for w, i in zip(weights, near)) / sum(weights)) < 2e-6


def test_defined_cases(spark):
    good = [(i, f"The cat number {i} sat on a mat and slept.\nIt was happy.", 1) for i in range(20)]
    bad = [(100 + i, f"BUY!! NOW!! {i}!! $$$ ###\n" * 4, 0) for i in range(20)]
    docs = spark.createDataFrame([*[(i, t, "x") for i, t, _ in good + bad], (1000, None, None), (1001, "", "x"), (1001, "", "x"), (None, "a " * 80_000, "y")], "doc_id long, text string, score string").withColumn("body", F.lit(1))
    labels = spark.createDataFrame([*[(i, y) for i, _, y in good + bad], (5, 1), (None, 1), (7777, 0), (1000, 0), (1001, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model, name="s")
    assert got.columns == [*docs.columns, "s"] and quality.score(docs, model).columns == [*docs.columns, "score_"]
    rows = got.collect()
    assert len(rows) == 44 and all(0 <= r.s <= 1 for r in rows)
    assert all(r.s > 0.5 for r in rows if r.doc_id is not None and r.doc_id < 100) and all(r.s < 0.3 for r in rows if r.doc_id is not None and 100 <= r.doc_id < 200)
    assert len({r.s for r in rows if r.doc_id in (1000, 1001)}) == 1
    assert quality.score(docs.limit(0), model, name="s").count() == 0
    assert {r.s for r in quality.score(docs, quality.fit(docs, labels.limit(0)), name="s").collect()} == {0.5}
