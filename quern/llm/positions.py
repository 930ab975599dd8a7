"""Benchmark decontamination by a stored positional inverted index.

The index is partitioned by documents: each segment holds about a megabyte of texts, numbers their words in one
running space (with a gap between documents), and keeps for every term the sorted list of its positions.  Segments
are rows of a stored table, built in one pass without a shuffle.

The phrases of the items are a table too.  The index gives the number of occurrences of each of their terms; a phrase
with a term that occurs nowhere is dropped, any other is anchored at its rarest term.  A segment visits the phrases of
the anchors that it has, and no others: the anchor's positions, less its offset in the phrase, are intersected with
the offset-adjusted lists of the other terms in order of rarity.  Proximity matches keep a place of the rarest term
where every other term lies within a distance.

Anchored phrases go to the executors in blocks of bounded size; each block is one pass over the stored index, whose
matches are stored before the next block is sent and this one is dropped.

Words: ASCII letters are lowered, words are runs of ASCII letters, digits and whatever is not ASCII.

Defined cases: null, empty and wordless texts have no words and no hits; repeated rows are rows of their own; a very
long text is a segment of its own; items without words give no phrase, rows that repeat an item_id are one item, and
the passages of a null item_id are hits like any other, though it has no name to be listed or counted by; other columns
are not looked at and may have any name; an empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, slices, stored, with_uid

SEGMENT_BYTES = 1 << 20
GAP = 64
#: Words of phrases that one pass sends to the executors.
BLOCK_WORDS = 2_000_000
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Terms of phrases that are broadcast to be counted; more of them are joined.
MOST_TERMS = 1_000_000
#: Terms of a block of phrases up to which a segment's terms are looked up all at once.
FEW_TERMS = 50_000
_INDEX = "uids array<long>, keys array<string>, sizes array<int>, terms array<binary>, counts array<int>, places binary"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES, uid: str | None = None) -> DataFrame:
    """The stored index: a row for each segment.  uids are those of the column uid, or made here; they are unique to rows."""
    source = docs.select(F.col(uid).alias("uid") if uid else F.monotonically_increasing_id().alias("uid"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", segment_bytes):
            bodies = pa.array([(x or "").encode("utf-8").translate(_WORD) for x in batch.column("text").to_pylist()], pa.binary())
            found = pc.ascii_split_whitespace(bodies.cast(pa.string()))
            flat, owner = found.flatten(), pc.list_parent_indices(found).to_numpy()
            there = pc.greater(pc.binary_length(flat), 0)
            coded = flat.filter(there).dictionary_encode()
            owner = owner[there.to_numpy(zero_copy_only=False)]
            term, number = coded.indices.to_numpy().astype(np.int32), coded.dictionary.cast(pa.binary())
            sizes = np.bincount(owner, minlength=batch.num_rows).astype(np.int32)
            place = np.arange(len(term), dtype=np.int32) + (owner * GAP).astype(np.int32)
            counts = np.bincount(term, minlength=len(number)).astype(np.int32)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [
                    one(batch.column("uid"), pa.int64()), one(batch.column("key"), pa.string()), one(sizes, pa.int32()), one(number, pa.binary()), one(counts, pa.int32()),
                    pa.array([place[np.argsort(term, kind="stable")].tobytes()], pa.binary()),
                ],
                names=["uids", "keys", "sizes", "terms", "counts", "places"],
            )

    return stored(source.mapInArrow(run, _INDEX), "postings")


def documents(index: DataFrame) -> DataFrame:
    """(uid, key, n_words) of every indexed row."""
    each = index.select(F.explode(F.arrays_zip("uids", "keys", "sizes")).alias("d"))
    return each.select(F.col("d.uids").alias("uid"), F.col("d.keys").alias("key"), F.col("d.sizes").cast("long").alias("n_words"))


class Segment:
    """One segment, narrowed to the terms that are asked for."""

    def __init__(self, row: pa.RecordBatch, vocabulary: dict[bytes, int], listed: pa.Array | None = None):
        of = lambda name: row.column(name)[0].values
        self.uids, self.sizes = of("uids").to_numpy(), of("sizes").to_numpy().astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes + GAP)[:-1]]
        ends, places = np.cumsum(of("counts").to_numpy(), dtype=np.int64), np.frombuffer(row.column("places")[0].as_buffer(), np.int32)
        self.counts, self.lists = np.zeros(len(vocabulary), np.int64), {}
        terms = of("terms")
        known = ((i, vocabulary.get(t)) for i, t in enumerate(terms.to_pylist())) if listed is None else enumerate(pc.index_in(terms, listed).to_pylist())
        for i, v in known:
            if v is not None:
                self.lists[v] = places[ends[i - 1] if i else 0 : ends[i]]
                self.counts[v] = len(self.lists[v])

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand in a row."""
        order = np.argsort(self.counts[terms], kind="stable")
        at = self.lists[int(terms[order[0]])] - order[0]
        for offset in order[1:].tolist():
            if not len(at):
                break
            having = self.lists[int(terms[offset])]
            i = np.searchsorted(having, at + offset)
            at = at[(i < len(having)) & (having[np.minimum(i, len(having) - 1)] == at + offset)]
        return at

    def near(self, terms: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) places around the rarest term's where each other term is within the distance, in one document."""
        terms = np.unique(terms)
        order = terms[np.argsort(self.counts[terms], kind="stable")]
        at = self.lists[int(order[0])].astype(np.int64)
        low, high, doc = at.copy(), at.copy(), self.doc(at)
        for term in order[1:].tolist():
            having = self.lists[term].astype(np.int64)
            i = np.searchsorted(having, at)
            left, right = having[np.maximum(i - 1, 0)], having[np.minimum(i, len(having) - 1)]
            best = np.where(abs(left - at) <= abs(right - at), left, right)
            ok = (abs(best - at) <= distance) & (self.doc(best) == doc)
            at, low, high, doc = at[ok], np.minimum(low, best)[ok], np.maximum(high, best)[ok], doc[ok]
        return low, high

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _merged(item: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of an item as one."""
    order = np.lexsort((start, item))
    item, start, end = item[order], start[order], end[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (start[1:] > end[:-1])]  # ends rise with starts: a phrase's ranges have one length
    first = np.flatnonzero(new)
    return item[first], start[first], np.maximum.reduceat(end, first)


def phrases(benchmark: DataFrame, key: str, text: str, window: int | None) -> DataFrame:
    """(item, terms): the phrases of every item, each once; a null key is an item without a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                found = words(text)
                size = len(found) if window is None else min(window, len(found))
                n = len(found) - size + 1 if found else 0
                for at in range(0, n, 4096):
                    cut = [found[i : i + size] for i in range(at, min(at + 4096, n))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array(cut, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "item string, terms array<binary>").distinct()


def anchored(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item, terms, anchor): phrases of whose terms none is missing from the index, and the place of the rarest one."""
    placed = wanted.withColumn("id", F.xxhash64("item", "terms")).select("id", "item", "terms", F.posexplode("terms").alias("place", "term"))
    vocabulary = stored(placed.select("term").distinct(), "terms")
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").cast("long").alias("n"))
    if vocabulary.count() <= MOST_TERMS:
        counts = held.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("n").alias("n"))
    else:  # counted first, so that a frequent term is one row before rows are dealt
        counts = held.groupBy("term").agg(F.sum("n").alias("n")).join(vocabulary, "term")
    counts = stored(counts, "counts")
    rarest = placed.join(counts, "term", "left").groupBy("id", "item", "terms").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place")).alias("least"))
    return rarest.where("least.n > 0").select("item", "terms", F.col("least.place").alias("anchor"))


def _blocks(rows: DataFrame, most: int) -> Iterator[list[tuple[str | None, list[bytes], int]]]:
    """Phrases in blocks of about `most` words, as they come from the executors."""
    block, held = [], 0
    for r in rows.toLocalIterator():
        if block and held + len(r.terms) > most:
            yield block
            block, held = [], 0
        block.append((r["item"], [bytes(t) for t in r.terms], r.anchor))
        held += len(r.terms)
    if block:
        yield block


def matches(index: DataFrame, benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int | None = 13, distance: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(uid, item, start, end): runs of words of indexed rows that an item's phrases cover, end exclusive; stored.

    window: an item's phrases are its runs of so many words, or all its words if it has fewer; None: all its words
    as one phrase.  distance: instead of phrases, all the item's words within that many words of its rarest one.
    """
    spark, found = index.sparkSession, None
    fields = index.select("uids", "sizes", "terms", "counts", "places")
    wanted = stored(anchored(index, phrases(benchmark, key, text, None if distance is not None else window)), "phrases")
    for block in _blocks(wanted, block_words):
        vocabulary: dict[bytes, int] = {}
        coded = [(item, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in terms], np.int32), anchor) for item, terms, anchor in block]
        sent = spark.sparkContext.broadcast((vocabulary, coded))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary, coded = sent.value
            by_anchor: dict[int, list[int]] = {}
            for number, (_, terms, anchor) in enumerate(coded):
                by_anchor.setdefault(int(terms[anchor]), []).append(number)
            names = sorted({item for item, _, _ in coded if item is not None})
            owner = {name: i for i, name in enumerate(names)}
            listed = pa.array(list(vocabulary), pa.binary()) if len(vocabulary) <= FEW_TERMS else None
            for batch in batches:
                for at in range(batch.num_rows):
                    segment = Segment(batch.slice(at, 1), vocabulary, listed)
                    item, start, end = [], [], []
                    for anchor in segment.lists.keys() & by_anchor.keys():
                        for number in by_anchor[anchor]:
                            name, terms, _ = coded[number]
                            if not segment.counts[terms].all():
                                continue
                            if distance is None:
                                begin = segment.phrase(terms)
                                stop = begin + len(terms)
                            else:
                                begin, stop = segment.near(terms, distance)
                                stop = stop + 1
                            item.append(np.full(len(begin), owner.get(name, -1)))
                            start.append(begin.astype(np.int64))
                            end.append(stop.astype(np.int64))
                    if item and sum(map(len, item)):
                        item, start, end = _merged(*map(np.concatenate, (item, start, end)))
                        doc = segment.doc(start)
                        begin = segment.starts[doc]
                        yield pa.RecordBatch.from_arrays([pa.array(segment.uids[doc]), pa.array([names[i] if i >= 0 else None for i in item.tolist()], pa.string()), pa.array(start - begin), pa.array(end - begin)], names=["uid", "item", "start", "end"])

        part = stored(fields.mapInArrow(run, "uid long, item string, start long, end long"), "hits")
        sent.unpersist()
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], "uid long, item string, start long, end long")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, uid: str | None = None) -> DataFrame:
    """(uid, key as text, n_words, n_hit, items, contaminated) of every row of docs.

    n_hit counts words inside any occurrence of a phrase; a row is contaminated if share * n_hit >= n_words > 0 and
    something is hit.
    """
    index = build(docs, key, text, uid=uid)
    hits = matches(index, benchmark, item_key, item_text, window)
    before = Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh_words = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))
    per = hits.withColumn("reached", reached).groupBy("uid").agg(F.sum(fresh_words).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    joined = documents(index).join(per, "uid", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return joined.select("uid", "key", "n_words", hit.cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, each judged by its own number."""
    (uid,) = fresh(docs, "uid")
    marked = with_uid(docs, uid)
    bad = contamination(marked, benchmark, key, text, uid=uid, **options).where("contaminated").select(F.col("uid").alias(uid))
    return marked.join(bad.hint("shuffle_hash"), uid, "left_anti").select(*docs.columns)


def oracle(window: int = 13, share: int = 20) -> str:
    """DuckDB SQL of the query: every run of words of a document against every phrase."""
    words_of = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words_of("text")} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {words_of("text")} AS w FROM benchmark),
bp AS (SELECT item, w, least(len(w), {window}) AS n, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM bp),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
m AS (SELECT rid, item, i, p.n FROM (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM dp) g JOIN p ON g.n = p.n AND g.gram = p.gram),
h AS (SELECT rid, count(DISTINCT hit) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS hit FROM m) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
