"""The pipeline's near-duplicates, five-word Jaccard 0.8 or more, against all pairs, and defined cases."""

import random

import pytest

import corpus_pipeline
from quern.llm import simhash


def slow_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_roots(texts):
    sets = [slow_set(t) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(sets))]


def planted():
    """Chains of edited copies around the threshold, texts that share a common line, short and odd texts."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "a b c", "A B  C", "one two three four five six"]
    line = " ".join(words[:12])
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(6):
            texts.append(" ".join(text))
            text = text.copy()
            for _ in range(rng.randint(0, max(1, len(text) // 45))):
                text[rng.randrange(len(text))] = rng.choice(words)
    return texts + [f"{line} {' '.join(rng.choices(words, k=9))}" for _ in range(40)] + ["x " * 30_000]


@pytest.mark.parametrize("part", [256, 3])
@pytest.mark.parametrize("real", [False, True])
def test_groups_as_all_pairs(spark, monkeypatch, real, part):
    """What stays is what all pairs give, but for links that the fingerprints miss; small parts take the way of large families."""
    monkeypatch.setattr(simhash, "PART", part)
    rows = planted()
    if real:
        rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    want = {i for i, r in enumerate(slow_roots(rows)) if i == r}
    assert want <= kept and len(kept - want) <= 0.05 * (len(rows) - len(want))


def test_similarity_links_as_all_pairs():
    rows = planted()
    sets = [simhash.shingles(t)[0] for t in rows]
    for open_ in (len(sets), 20):
        a, b = simhash._similar(sets, open_)
        root = list(range(len(sets)))
        for x, y in zip(a, b):
            root[x] = y
        want = slow_roots(rows)
        for i in range(open_):  # open sets have the partners that all pairs give
            assert {j for j in range(len(sets)) if root[j] == root[i] and len(sets[j])} == {j for j in range(len(sets)) if want[j] == want[i] and len(sets[j])} or not len(sets[i])


def test_stage_drops_what_four_bits_do_not_link(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    a, b = slow_set(texts[1]), slow_set(texts[177])
    assert len(a & b) / len(a | b) >= 0.8 and (simhash.fingerprint(texts[1]) ^ simhash.fingerprint(texts[177])).bit_count() > 4
    docs = spark.createDataFrame([(i, texts[i]) for i in (1, 177)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()] == [1]


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (7, "A B C"), (7, "A B C"), (7, "d e f"), (8, "d e f g h i j k l m n o p q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as text_hash", "'clash' as root", "'clash' as sid")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(7, "A B C"), (7, "d e f"), (8, rows[-1][1])]
    assert kept.count() == 4 and simhash.keep_one(docs.limit(0)).count() == 0
