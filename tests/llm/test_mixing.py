"""Context mixing: a plain bit-by-bit mixer, the base by hand, held-out gain, defined cases."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from quern.llm import mixing as m


M32, M64 = (1 << 32) - 1, (1 << 64) - 1
SPACES = {9, 10, 11, 12, 13, 32, m.END}


def plain_hashes(symbols, i):
    """The hashes of what stands before symbol i: the last 2, the last 4, the word so far."""
    past, mixed, out = [symbols[i - k] if i >= k else m.END for k in range(1, 5)], 0, []
    for back, symbol in enumerate(past, 1):
        mixed = ((mixed ^ (symbol + 1)) * 0x01000193 + 0x3C6EF372) & M32
        if back in (2, 4):
            out.append(mixed)
    begin = i
    while begin and symbols[begin - 1] not in SPACES:
        begin -= 1
    word = 0
    for k in range(begin, i):
        word += (symbols[k] + 1) * pow(0x9E3779B97F4A7C15, i - k, 1 << 64)
    return [*out, ((word & M64) >> 32) ^ (past[0] * 0x7F4A7C15 & M32)]


def plain_cost(mixer, text):
    """One text, one bit at a time, with hashes of its own."""
    symbols = [*text, m.END]
    k = len(m.TABLES)
    delta, grad, total = [0.0] * k, [0.0] * k, 0.0
    for i, symbol in enumerate(symbols):
        if i and i % m.EVERY == 0:
            delta = [d + m.OWN_RATE * m.STEP**2 * g for d, g in zip(delta, grad)]
            grad = [0.0] * k
        hashes = plain_hashes(symbols, i)
        pair = (symbols[i - 1] if i else m.END) * 257 + symbol
        first, gate = int(mixer.code.first[pair]), 0
        for number in range(int(mixer.code.length[pair])):
            node, bit = int(mixer.code.node[first + number]), int(mixer.code.bit[first + number])
            odds = [int(t[((h * 0x85EBCA6B & M32) >> (32 - w)) + node & (1 << w) - 1]) for t, h, w in zip(mixer.tables, hashes, m.TABLES)]
            if number == 0:
                gate = 3 * ((odds[1] != 0) + 2 * (odds[2] != 0))
            x = [o * (2 * bit - 1) for o in odds]
            y = max(-16, min(16, sum((float(mixer.weights[j][gate + min(number, 2)]) + delta[j]) * x[j] for j in range(k))))
            total += math.log1p(math.exp(-y))
            share = math.exp(-y) / (1 + math.exp(-y))
            grad = [g + v * share for g, v in zip(grad, x)]
    return total


def test_costs_as_one_bit_at_a_time(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixer = m.fit(docs, "doc_id", "text", m.crc_mod("doc_id", 10), 10)
    rows = [(r.text or "").encode() for r in docs.where("length(text) < 700").limit(6).collect()]
    texts = [b"", b"a", *rows]
    cost = lambda ts: [float(x.astype(float).sum()) for x in mixer.costs(ts)]
    for text, got in zip(texts, cost(texts)):
        assert abs(got - plain_cost(mixer, text)) < 1e-3 * max(1, got)
    assert [x.tolist() for x in mixer.costs(texts)] == [mixer.costs([t])[0].tolist() for t in texts]
    # a proper distribution: after a text, all continuations by one symbol and the end take the whole share
    assert sum(math.exp(-c) for c in cost([bytes([b]) for b in range(255)])) <= 1


def test_pieces_have_the_contexts_of_the_whole_text(monkeypatch):
    rng = np.random.default_rng(4)
    letters = lambda n: bytes(rng.integers(97, 123, n).tolist())
    texts = [b"of the " * 700 + letters(9000) + b" and " + letters(300), letters(5000) + b" " + letters(1), b"a b"]
    whole = [m.contexts(np.array([*t, m.END], np.int16), np.array([0]))[:2] for t in texts]
    monkeypatch.setattr(m, "PIECE", 1000)
    got = {}
    for _, before, hashes, place, doc in m._windows(texts):
        for i, (b, d, p) in enumerate(zip(before.tolist(), doc.tolist(), place.tolist())):
            got[d, p] = (b, *(int(h[i]) for h in hashes))
    assert got == {(d, p): (int(before[p]), *(int(h[p]) for h in hashes)) for d, (before, hashes) in enumerate(whole) for p in range(len(before))}


def test_layout_does_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = sorted(map(tuple, m.scores(docs.coalesce(1)).collect()))
    assert one == sorted(map(tuple, m.scores(docs.repartition(7), chunk_bytes=50_000).collect()))


def plain_pairs(text):
    """(before, segment) of a text: runs of words that end where a word's hash is a multiple of SEGMENT, or the text does."""
    out, now = [], []
    words = text.encode().split(b" ")
    for i, word in enumerate(words):
        now.append(word)
        if i == len(words) - 1 or xxhash.xxh3_64_intdigest(word) % m.SEGMENT == 0:
            out.append((tuple(now), i == len(words) - 1))
            now = []
    return list(zip(out, out[1:]))


def test_segments_as_counted_by_hand(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] * 2
    train = np.arange(len(texts)) % 3 > 0
    counts = Counter(p for t, on in zip(texts, train) for p in plain_pairs(t) if on)
    sums, parts = m.Totals(), [m.Chunk.of(pa.array(texts[i::4]), train[i::4]) for i in range(4)]
    for c in parts:
        sums.add(c.tokens, c.counts, c.contexts, c.segments, c.pair_counts)
    known = m.Known(sums.tokens, *sums.settle())
    follow = {}
    for (a, b), n in counts.items():
        follow.setdefault(a, {})[b] = n
    for i, c in enumerate(parts):
        own, other = known.pairs_of(c.contexts, c.segments)
        wanted = [p for t in texts[i::4] for p in plain_pairs(t)]
        there = c.pair[c.pair >= 0]
        assert own[there].tolist() == [counts[p] for p in wanted]
        assert other[there].tolist() == [max((n for s, n in follow.get(a, {}).items() if s != b), default=0) for a, b in wanted]
        assert c.symbols.sum() == sum(len(t.encode()) + 1 for t in texts[i::4])


def test_texts_that_occur_twice_stand_apart(spark):
    """Copies in the training rows cost far less than texts that occur once; held-out copies of training rows too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("length(text) between 1500 and 6000")
    few = docs.orderBy("doc_id").limit(30).selectExpr("doc_id + 1000000 AS doc_id", "text")
    copies = {r.doc_id for r in few.collect()}
    train = {i for i in copies if zlib.crc32(str(i).encode()) % 10 and zlib.crc32(str(i - 1000000).encode()) % 10}
    bits = {r.doc_id: r.bits_per_byte for r in m.scores(docs.union(few)).collect()}
    texts = Counter(r.text for r in docs.collect())
    once = [bits[r.doc_id] for r in docs.collect() if texts[r.text] == 1 and r.doc_id + 1000000 not in copies]
    twice = [bits[i] for i in train]
    assert np.mean([b < np.quantile(once, 0.02) for b in twice]) > 0.9
    assert abs(m.event_cost(np.array([3.0, 4.0]), np.array([0, 0]), np.array([0, 0])) - 7) < 1e-9


def test_base_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in m.scores(docs, chunk_bytes=300_000).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.bits_per_byte * r.n_tokens for r in held) / sum(r.n_tokens for r in held) < 2.9


def test_defined_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a b a", 1), (3, "a b a", 1), (None, "é 😀", 2), (14, "a " * 60_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int").withColumn("score", F.lit("clash")).withColumn("uid", F.lit("clash"))
    got = m.scores(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 1), ("14", 60_001), ("2", 1), ("3", 4), ("3", 4), ("None", 3)]
    assert len({(r.base_score, r.score) for r in got if r.doc_id == 3}) == 1
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert m.scores(docs.limit(0)).collect() == []
    nothing = m.scores(docs.where("doc_id = 2"), modulus=1).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in nothing] == [(True, 0, 0)]


def test_weights_are_learned_from_all_training_rows(spark):
    """Every bit of every training row is tallied once, in the half that the row's text is not counted in."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(3)
    fold = m.crc_mod("doc_id", 10)
    train = docs.where(fold != 0).select("text", (F.pmod(F.xxhash64("text"), F.lit(2)) == 1).alias("half"))
    code = m.Code.of(m.pair_counts(train.select("text")))
    first, second, every = m.log_odds(train, code)
    counts = m.tallied(train, code, first, second)
    bits = 0
    for r in train.collect():
        symbols = np.array([*(r.text or "").encode(), m.END])
        bits += int(code.length[np.r_[m.END, symbols[:-1]] * 257 + symbols].sum())
    assert counts.sum() == bits
    halves = [m._encoded([r.text for r in train.where(on).collect()]) for on in ("not half", "half")]
    assert (counts.ravel() == m.Mixer.start(code, second).tally(halves[0]) + m.Mixer.start(code, first).tally(halves[1])).all()
    weights = m.learned(counts)
    assert (m.fit(docs, "doc_id", "text", fold, 10).weights == weights).all()
    cost = lambda w: sum(float(c.sum()) for i, t in ((0, second), (1, first)) for c in m.Mixer(code, t, w).costs(halves[i][:200]))
    assert cost(weights) < cost(m.Mixer.start(code, every).weights)


def test_few_bits_are_held_at_once():
    """Bits are worked on as many at a time as caches hold: arrays of all bits of a group were where the CPU seconds went (F1 of round 2)."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for _ in range(128)]
    code = m.Code.of(np.ones((257, 257), np.int64))
    mixer = m.Mixer.start(code, [np.ones(1 << w, np.int8) for w in m.TABLES])
    symbols = sum(len(t) + 1 for t in texts)
    peaks = []
    for work in (mixer.costs, mixer.tally):
        tracemalloc.start()
        work(texts)
        peaks.append(tracemalloc.get_traced_memory()[1] / symbols)
        tracemalloc.stop()
    assert max(peaks) < 200, peaks


def test_pairs_as_counted_one_by_one(spark):
    texts = [None, "", "a", "a\0b", "x" * (1 << 20), "é " * (1 << 20), "b"]
    wanted = Counter()
    for t in texts:
        symbols = [m.END, *(t or "").encode(), m.END]
        wanted.update(zip(symbols, symbols[1:]))
    got = m.pair_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    assert {(int(a), int(b)): int(got[a, b]) for a, b in zip(*got.nonzero())} == wanted
