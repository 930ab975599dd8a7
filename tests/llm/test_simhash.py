"""SimHash against brute force, and its defined cases."""

import random

import xxhash
from pyspark.sql import functions as F

from quern.llm import simhash


def slow_print(text, width=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=4):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_fingerprints_and_components_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    prints = [slow_print(r.text) for r in rows]
    want = {r.doc_id: (p, rows[c].doc_id) for r, p, c in zip(rows, prints, slow_components(prints))}
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == want


def test_links_span_planted_chains_in_every_number_of_blocks(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(300)]
    for start in list(values[:40]):
        for _ in range(rng.randint(1, 40)):
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                start ^= 1 << bit
            values.append(start)
    values = sorted(set(values), key=lambda v: v - 2**64 if v >= 2**63 else v)
    want = slow_components(values)
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    for blocks, cell in ((5, 2048), (6, 16), (7, 2048)):
        roots = dict(map(tuple, simhash.components(simhash.links(frame, 4, blocks, cell)).collect()))
        signed = [v - 2**64 if v >= 2**63 else v for v in values]
        assert [roots.get(v, v) for v in signed] == [signed[c] for c in want]


def test_defined_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (None, "a b c", "y"), (7, "A B C", None), (7, "A B C", None), (8, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("text_hash", F.lit("clash"))
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    assert {(i, c) for i, _, c in got} == {(1, 1), (2, 1), (3, 1), (None, 7), (7, 7), (8, 8)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_small_components_take_few_jobs_and_large_ones_the_same_roots(spark):
    rng = random.Random(6)
    ids = [rng.getrandbits(63) - (1 << 62) for _ in range(400)]
    edges = [(ids[i], ids[i + 1]) for i in range(150)] + [(ids[200], ids[i]) for i in range(201, 290)] + [(ids[rng.randrange(290, 400)], ids[rng.randrange(290, 400)]) for _ in range(80)]
    frame = spark.createDataFrame([*edges, *edges[:20], (ids[5], ids[5])], "a long, b long")
    spark.sparkContext.setJobGroup("small", "small")
    few = simhash.components(frame)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("small"))
    spark.sparkContext.setJobGroup("large", "large")
    rounds = sorted(map(tuple, simhash.components(frame, few=-1).collect()))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    reach = {i: {i} for e in edges for i in e}
    for a, b in edges:
        if reach[a] is not reach[b]:
            reach[a] |= reach[b]
            for i in reach[b]:
                reach[i] = reach[a]
    assert sorted(map(tuple, few.collect())) == rounds == sorted((i, min(r)) for i, r in reach.items() if i != min(r))
    assert 0 < jobs <= 8  # rounds take some dozens
    assert simhash.components(frame.limit(0)).collect() == []
