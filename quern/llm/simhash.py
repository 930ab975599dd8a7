"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components.

A fingerprint has 64 bits.  Cut into b blocks, two fingerprints that differ in at most d bits agree in at
least b - d whole blocks, so they meet in one of the C(b, d) tables keyed by b - d blocks.  Pairs are verified
where they meet, and each bucket gives a spanning forest of its links, never all pairs.  Results do not depend
on b, which only follows the number of distinct fingerprints so that chance meetings stay in proportion to it.

keep_one() has a stricter notion of near-duplicates: the Jaccard similarity of five-word shingles is 0.8 or more.
Few of 64 bits cannot show that, as similarity 0.8 changes ten bits of the shingles' own fingerprint.  A fingerprint of
the distinct words changes by four such bits where edits are scattered, so candidates meet in blocks of that one, at
up to WORD_BITS bits; they must also agree in the shingles' fingerprint up to SHINGLE_BITS, and in size.  Candidates
make families, and in a family every pair that is not linked yet is compared by its whole sets: only that links.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows stay repeated;
a null doc_id keeps its row and counts for component_id only where a component has no other id; a very long text is
one row's work, in memory in proportion to it.  Columns beyond the key and the text are not looked at, and may have any
name.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, fresh, groups, slices, split_join, stored, with_uid

BITS = 64
#: Fingerprints that one comparison cell takes from one side; larger buckets are dealt to cells of pairs of parts.
CELL = 2048
#: keep_one: shingle width, and the bits in which candidates may differ, of the words' and of the shingles' fingerprint.
WIDTH, WORD_BITS, SHINGLE_BITS = 5, 8, 20
#: Chance meetings of a fingerprint that blocks_for allows.
CHANCE = 4.0
#: Sets and shingles of a part of a family; two parts meet in a cell.
PART, PART_SHINGLES = 256, 1 << 19
#: Edges that one task connects at once; more are contracted by all tasks first.
EDGES = 1 << 19
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The majority of the XXH64 values (seed 42) of all word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -width].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    values = np.array(hashes, np.uint64)
    return majority(values)


def majority(values: np.ndarray) -> int:
    """The bits that over half of the 64-bit values have."""
    half, cuts, result = len(values), np.arange(0, len(values), 255), 0
    if not half:
        return 0
    for shift in range(8):  # eight byte counters in each word, emptied before they overflow
        lanes = np.add.reduceat((values >> np.uint64(shift)) & _LANES, cuts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > half).tolist():
            result |= 1 << (8 * byte + shift)
    return result


def shingles(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """The sorted XXH64 values (seed 42) of a text's distinct shingles, and the fingerprint of its distinct words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64), 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    kinds = set(words)
    of_words = majority(np.fromiter((digest(w, 42) for w in kinds), np.uint64, len(kinds)))
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64), of_words
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)), of_words


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(key, fp long, text_hash long) of every row; text_hash tells copies of a key's texts apart."""
    source = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("text_hash"))
    schema = source.select(key, F.lit(0).cast("long").alias("fp"), "text_hash").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            values = np.array([fingerprint(x, width) for x in batch.column(text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(values.view(np.int64)), batch.column("text_hash")], names=schema.names)

    return source.mapInArrow(run, schema)


def blocks_for(distinct: int, distance: int, chance: float = CHANCE) -> int:
    """The smallest number of blocks at which chance meetings stay under `chance` a fingerprint."""
    for blocks in range(distance + 1, 4 * distance + 4):
        bits = BITS * (blocks - distance) // blocks
        if comb(blocks, distance) * max(distinct, 1) / 2.0 ** (bits + 1) <= chance:
            return blocks
    return blocks


def _tables(fp, distance: int, blocks: int):
    """An array of (table, bucket): each choice of blocks - distance blocks, and their bits."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    found = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        bucket = F.lit(0).cast("long")
        for i in chosen:
            width = cuts[i + 1] - cuts[i]
            bucket = F.shiftleft(bucket, width).bitwiseOR(F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << width) - 1)))
        found.append(F.struct(F.lit(number).alias("t"), bucket.alias("bucket")))
    return F.array(*found)


Agree = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _near(rows: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int, agree: Agree | None) -> np.ndarray:
    """Whether rows a and b, whose first line is the fingerprint, are near, and agree in the other lines."""
    found = np.bitwise_count((rows[0, a] ^ rows[0, b]).view(np.uint64)) <= distance
    return found & agree(rows[1:, a], rows[1:, b]) if agree else found


def _spanned(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that span the components of pairs among n rows; a root is its component's first row."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _forest(rows: np.ndarray, distance: int, agree: Agree | None, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that span the components of one cell's fingerprints; the cell bounds what is compared."""
    pairs_a, pairs_b = [], []
    n = rows.shape[1]
    for at in range(0, n, block):
        near = np.bitwise_count((rows[0, at : at + block, None] ^ rows[0, None, at:]).view(np.uint64)) <= distance
        a, b = np.nonzero(np.triu(near, 1))
        if agree is not None and len(a):
            ok = agree(rows[1:, a + at], rows[1:, b + at])
            a, b = a[ok], b[ok]
        pairs_a.append(a + at)
        pairs_b.append(b + at)
    return _spanned(np.concatenate(pairs_a), np.concatenate(pairs_b), n)


def _linked(group: np.ndarray, rows: np.ndarray, distance: int, agree: Agree | None = None, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of every run of equal group numbers."""
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(cuts)
    members, roots = [], []
    for start, size in zip(cuts[:-1][sizes > small].tolist(), sizes[sizes > small].tolist()):
        a, b = _forest(rows[:, start : start + size], distance, agree)
        members.append(a + start)
        roots.append(b + start)
    keep = np.repeat((sizes > 1) & (sizes <= small), sizes)
    places = np.flatnonzero(keep)
    group, here = group[places], rows[:, places]
    pairs_a, pairs_b = [], []
    for step in range(1, small):
        if step >= len(places):
            break
        at = np.flatnonzero(group[step:] == group[:-step])
        if not len(at):
            break
        at = at[_near(here, at, at + step, distance, agree)]
        pairs_a.append(at)
        pairs_b.append(at + step)
    if pairs_a:
        moved, root = _spanned(np.concatenate(pairs_a), np.concatenate(pairs_b), len(places))
        members.append(places[moved])
        roots.append(places[root])
    return (np.concatenate(members), np.concatenate(roots)) if members else (np.empty(0, int), np.empty(0, int))


def links(distinct: DataFrame, distance: int = 4, blocks: int | None = None, cell: int = CELL, node: str = "fp", also: Sequence[str] = (), agree: Agree | None = None, chance: float = CHANCE) -> DataFrame:
    """(a, b): links that connect whatever is within the distance, directly or by others, among distinct fingerprints `fp`.

    Rows go by the whole number in `node`; with agree, pairs must pass it too, on the whole numbers of the columns `also`.
    """
    blocks = blocks or blocks_for(distinct.count(), distance, chance)
    carried = [*dict.fromkeys(["fp", *also, node])]
    keyed = distinct.select(*carried, F.explode(_tables(F.col("fp"), distance, blocks)).alias("k")).select(*carried, "k.t", "k.bucket")
    hot = keyed.groupBy("t", "bucket").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > cell)
    parts = F.ceil(F.coalesce(F.col("n_rows"), F.lit(1)) / F.lit(cell)).cast("int")
    mine = F.pmod(F.xxhash64(node), F.col("parts")).cast("int")
    cells = (
        keyed.join(hot, ["t", "bucket"], "left")
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*carried, "t", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    names = ["t", "bucket", "i", "j"]
    dealt = cells.repartition(*names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in [*names, *carried]])
            new = new if held is None else np.concatenate([held, new], axis=1)
            if not new.shape[1]:
                continue
            ahead = np.flatnonzero((new[:4, 1:] != new[:4, :-1]).any(axis=0))
            cut = ahead[-1] + 1 if len(ahead) else 0  # the last cell may go on in the next batch
            held, now = new[:, cut:], new[:, :cut]
            yield from pairs(now)
        if held is not None:
            yield from pairs(held)

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1] > 1:
            group = np.r_[0, np.cumsum((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))]
            own = np.ascontiguousarray(rows[4:])
            a, b = _linked(group, own[: 1 + len(also)], distance, agree)
            if len(a):
                ids = own[carried.index(node)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _connected(edges: DataFrame) -> DataFrame:
    """components() of at most EDGES edges (u, v), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([batch.column(c).to_numpy() for c in ("u", "v")]) for batch in batches if batch.num_rows]
        if held:
            nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            member, root = _spanned(*ends.reshape(2, -1), len(nodes))  # nodes are in order, so a first row is a smallest node
            yield pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[root])], names=["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most: int = 60, few: int = EDGES) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches, by alternating large and small stars.

    Each round is two aggregations with partial sums and two joins, written to the shared folder; the number of
    rounds follows the logarithm of the longest chain.  Once at most `few` edges are left, one task connects them, so
    that a small table does not cost the driver the plans and tasks of all rounds.
    """

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = digest(edges)
    for _ in range(most):
        if before[0] <= few:
            last, edges = edges, stored(_connected(edges), "edges")
            forget(last)
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, edges = edges, stored(small, "edges")
        after = digest(edges)
        forget(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not final after {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(key, fp, text_hash, component_id, root) of every row; component_id is the smallest key that its fingerprint reaches.

    root is the component's smallest fingerprint, which tells components apart where a key repeats.
    """
    prints = stored(fingerprints(docs, key, text, width), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(key).alias("rep")), "distinct")
    roots = components(links(distinct, distance))
    owned = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = owned.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = owned.join(least, "root").select("fp", "component_id", "root")
    return split_join(prints, named, "fp").select(key, "fp", "text_hash", "component_id", "root")


def described(docs: DataFrame, text: str, width: int = WIDTH) -> DataFrame:
    """docs with sid, which tells sets of shingles apart, n (their sizes), fp (of words) and sfp (of shingles)."""
    source = docs.withColumn("text", F.col(text)) if text != "text" else docs
    kept = [c for c in source.columns if c != "text"]
    schema = source.select(*kept, *[F.lit(0).cast("long").alias(c) for c in ("sid", "n", "fp", "sfp")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = [shingles(x, width) for x in batch.column("text").to_pylist()]
            sids = [xxhash.xxh64_intdigest(v.tobytes(), 42) if len(v) else 0 for v, _ in found]
            numbers = [np.array(x, np.uint64).view(np.int64) for x in (sids, [f for _, f in found], [majority(v) for v, _ in found])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(numbers[0]), pa.array([len(v) for v, _ in found], pa.int64()), pa.array(numbers[1]), pa.array(numbers[2])], names=schema.names)

    return source.mapInArrow(run, schema)


def _alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether shingle fingerprints and sizes leave a similarity of 0.8 open."""
    close = np.bitwise_count((left[0] ^ right[0]).view(np.uint64)) <= SHINGLE_BITS
    return close & (5 * np.minimum(left[1], right[1]) >= 4 * np.maximum(left[1], right[1]))


def _similar(sets: list[np.ndarray], open_: int) -> tuple[list[int], list[int]]:
    """Links (member, root) that span what a Jaccard similarity of 0.8 or more connects to the first `open_` sets.

    Each set looks only at what none has reached.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [codes[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    mark, members, roots, left = np.zeros(len(known), np.int64), [], [], np.arange(len(sets))
    while len(left) > 1 and left[0] < open_:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            at = front.pop()
            fits = left[(5 * np.minimum(sizes[left], sizes[at]) >= 4 * np.maximum(sizes[left], sizes[at])) & (sizes[left] > 0)]
            if not len(fits):
                continue
            mark[own[at]] = 1
            shared = np.add.reduceat(mark[np.concatenate([own[i] for i in fits.tolist()])], np.r_[0, np.cumsum(sizes[fits])[:-1]])
            mark[own[at]] = 0
            near = fits[9 * shared >= 4 * (sizes[fits] + sizes[at])]
            members += near.tolist()
            roots += [root] * len(near)
            front += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return members, roots


def _centres(members: DataFrame) -> DataFrame:
    """(family, centre, centre_text): the member whose shingle fingerprint is nearest to the family's majority."""
    bit = [F.sum(F.shiftrightunsigned("sfp", k).bitwiseAND(F.lit(1))) for k in range(BITS)]
    whole = F.lit(0).cast("long")
    for k, b in enumerate(bit):
        whole = whole.bitwiseOR(F.when(2 * b > F.count("*"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0)))
    typical = split_join(members.select("family", "sid", "sfp"), members.groupBy("family").agg(whole.alias("typical")), "family")
    nearest = typical.groupBy("family").agg(F.min(F.struct(F.bit_count(F.col("sfp").bitwiseXOR(F.col("typical"))).alias("off"), "sid")).alias("c"))
    return members.join(nearest.select(F.col("c.sid").alias("sid")), "sid", "left_semi").select("family", F.col("sid").alias("centre"), F.col("text").alias("centre_text"))


def _star(members: DataFrame, width: int) -> DataFrame:
    """(a, b): members that are similar to their family's centre, and the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for whole in batches:
            for batch in slices([whole], "text"):
                a, b = [], []
                for sid, text, centre, other in zip(*(batch.column(c).to_pylist() for c in ("sid", "text", "centre", "centre_text"))):
                    if last[0] != centre:
                        last = centre, shingles(other, width)[0]
                    own = shingles(text, width)[0]
                    if sid != centre and 9 * len(np.intersect1d(own, last[1], assume_unique=True)) >= 4 * (len(own) + len(last[1])):
                        a.append(sid)
                        b.append(centre)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return split_join(members.select("family", "sid", "text"), _centres(members), "family").mapInArrow(run, "a long, b long")


def similar_links(members: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b): verified links that connect what similarity connects within families; members are (family, sid, n, sfp, text).

    A family is cut into parts of about PART sets or PART_SHINGLES shingles.  One of several parts is compared with
    its centre first, which settles most of a group of copies of one text; what that leaves open then meets all
    parts, two in a cell.
    """

    def cut(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("family").agg(F.count("*").alias("many"), F.sum("n").alias("held"))
        return found.select("family", F.greatest(F.ceil(F.col("many") / PART), F.ceil(F.col("held") / PART_SHINGLES), F.lit(1)).cast("int").alias("parts"))

    whole = cut(members)
    large = stored(split_join(members, whole.where("parts > 1"), "family").drop("parts"), "large")
    star = stored(_star(large, width), "star")
    settled = star.select(F.col("a").alias("sid")).union(star.select(F.col("b").alias("sid")).distinct())
    flagged = members.join(settled.withColumn("settled", F.lit(True)), "sid", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    flagged = stored(flagged, "flagged")
    counts = cut(flagged.where("not settled")).join(cut(flagged.where("settled")).withColumnRenamed("parts", "more"), "family", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    rows = split_join(flagged, counts, "family")  # families with nothing open drop out here
    mine = F.pmod(F.xxhash64("sid"), F.when(F.col("settled"), F.col("more")).otherwise(F.col("parts"))).cast("int")
    ends = F.when(F.col("settled"), F.col("parts")).otherwise(F.col("parts") + F.col("more"))
    place = F.when(F.col("settled"), F.col("parts") + F.col("mine")).otherwise(F.col("mine"))
    cells = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), ends - 1))).withColumn("place", place)
    keys = ["family", "i", "j"]
    cells = cells.select("family", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"), "settled", "sid", "text")
    cells = cells.repartition(*keys).sortWithinPartitions(*keys, "settled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups((b for x in batches for b in slices([x], "text")), keys):
            if cell.num_rows > 1:
                sid = cell.column("sid").to_numpy()
                open_ = cell.num_rows - pc.sum(cell.column("settled")).as_py()
                a, b = _similar([shingles(x, width)[0] for x in cell.column("text").to_pylist()], open_)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(sid[a]), pa.array(sid[b])], names=["a", "b"])

    return star.union(cells.mapInArrow(run, "a long, b long"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest key (null last), then text hash.

    Rows are near-duplicates at a Jaccard similarity of 0.8 or more of their shingles, directly or by others; texts
    without words are copies of each other, and so are rows that repeat key and text.
    """
    (uid,) = fresh(docs, "uid")
    whole = with_uid(docs, uid)
    rows = whole.select(F.col(uid).alias("uid"), F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    prints = stored(described(rows, "text", width), "prints")
    sets = stored(prints.groupBy("sid").agg(*[F.min(c).alias(c) for c in ("n", "fp", "sfp", "uid")]), "sets")  # one row for each set
    families = components(links(sets, WORD_BITS, node="sid", also=["sfp", "n"], agree=_alike, chance=1e4))
    named = families.select(F.col("root").alias("family"), F.col("node").alias("sid"))
    named = named.union(named.select("family", F.col("family").alias("sid")).distinct())
    members = stored(sets.join(named, "sid").select("family", "sid", "n", "sfp", "uid"), "members")
    # neither side of these two joins has a bound, so none is broadcast; the side without texts is hashed
    roots = components(similar_links(stored(rows.select("uid", "text").join(members.hint("shuffle_hash"), "uid"), "texts"), width))
    order = F.struct(F.col("key").isNull().alias("absent"), F.col("key").alias("id"), F.col("text_hash").alias("h"), F.col("uid").alias("uid"))
    grouped = split_join(prints.select("key", "text_hash", "uid", "sid"), roots.withColumnRenamed("node", "sid"), "sid", "left")
    first = grouped.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min(order).alias("w")).select(F.col("w.uid").alias(uid))
    return whole.join(first.hint("shuffle_hash"), uid, "left_semi").select(*docs.columns)
