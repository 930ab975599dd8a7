"""Language-model scoring by logistic context mixing, and a smoothed unigram base beside it.

A text is its UTF-8 bytes and an end symbol, each written in the bits of a Huffman code that the training texts
give for what follows the symbol before.  Three predictors give each bit's log odds: hashed contexts of the last 2 and
4 symbols and of the word so far, each with the node of the code tree.  A logistic mixer adds them up by weights that
a gate chooses (which of the longer contexts are known, and which bit of the symbol it is), and every text refines the
weights as it goes: after each block of symbols by the gradient of what that block cost.

What the whole corpus says about longer passages comes on top.  Texts are cut, by what stands there, into segments of
about sixteen words.  For every segment the corpus tells how often other training texts have it behind the segment
before, and how often any other; so the likeliest continuation is known before it is read.  Whether it comes true is
a gated event of its own: the gate is how often that continuation was seen and what became of the last one, and its
odds are refined within the text.  A segment's probability is that of the event and, besides, what the symbols cost
where it is not the likeliest.  These counts grow with the corpus; nothing of them is gathered in one place.

The sum of all costs is the text's log probability; as the end symbol is coded too, the probabilities of all texts sum
to at most 1.

Training is distributed.  Tasks count bits by hashed context in tables of fixed size, the tables' blocks are summed
after a shuffle, and their log odds, one byte each, are what is sent to the executors: a bound that does not depend on
the corpus.  All training rows teach the 36 weights: the texts are dealt to two halves by their hash, and each half is
read with the counts of the other, so that weights are learned on texts whose contexts are as new as those of held-out
texts.  One pass tallies every bit by its gate and the levels of its three log odds, in a table of fixed size, and Newton
steps are taken on the tally.  All sums are of whole numbers, so the model does not depend on how rows are dealt.

The base needs the training count of every token.  Rows are dealt to chunks of a few megabytes by their place; each
chunk sends its distinct tokens and segments, with counts, to hash buckets, an eighth as many as there are chunks.  A
bucket, as much as a few chunks, adds them up and answers each chunk; the chunk's rows meet the answers in a cogroup.
Tokens are told apart by themselves, segments by two 64-bit hashes.

Defined cases: null and empty texts are an end alone; repeated rows stay repeated, and equal texts of one key score the
same; null keys fall into the fold of the empty text; without training rows all predictors are silent and all counts
zero; a very long text is a chunk of its own, worked on piece by piece, with the contexts that the whole text has;
other columns are not looked at and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, groups, slices, stored, with_uid

END = 256
#: Symbols of the contexts, and log2 of the slots of each predictor's table: these, and the word so far.
BACK, TABLES = (2, 4), (18, 21, 21)
BLOCK_SLOTS = 1 << 14
#: One step of the stored log odds, in nats.
STEP = 0.125
GATES = 12
#: Symbols between two refinements of a text's weights, and their rate.
EVERY, OWN_RATE = 64, 0.003
#: The Newton steps that give the weights, and the levels of log odds, in steps, that their sums go by: a value counts at the nearest.
ROUNDS = 3
_HIGHER = np.array([1, 2, 3, 4, 6, 8, 10, 13, 16, 20, 26, 34, 45, 60, 85, 120])
LEVEL = np.r_[-_HIGHER[::-1], 0, _HIGHER]
_LEVEL_OF = np.abs(np.arange(-127, 128)[:, None] - LEVEL).argmin(axis=1).astype(np.int32)
#: A segment ends at words whose hash is a multiple of SEGMENT.
SEGMENT = 16
#: What an event's odds start from, as (hits, misses) by how often the continuation was seen, up to LEVELS times.
LEVELS, START = 4, ((0.4, 1.2), (0.8, 0.8), (1.2, 0.6), (1.6, 0.4))
#: Texts worked on together, in bytes, and bytes of a text worked on at once; where no text waits for another, as much as caches hold.
TOGETHER, PIECE, NEAR = 1 << 19, 1 << 16, 1 << 16
#: Where each predictor's slot lies in one number for all, with a bit to spare above it, and what adds 1 to all of them.
SHIFTS = tuple(sum(w + 1 for w in TABLES[:k]) for k in range(len(TABLES)))
ALL_SLOTS = sum(1 << s for s in SHIFTS)
assert SHIFTS[-1] + TABLES[-1] < 63
#: The node that every code begins with, and where a row says which contexts are known.
ROOT, KNOWN_AT = END - 1, 40
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.isin(np.arange(257), [9, 10, 11, 12, 13, 32, END])
_LEVELS = bytes(_LEVEL_OF[max(-127, v - 256 if v > 127 else v) + 127] for v in range(256))  # by a signed byte's pattern
#: Powers of the word hash's base, and of its inverse, as many as were needed so far.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


# ---- symbols, codes and contexts


@dataclass
class Code:
    """A binary code of the 257 symbols for each symbol before; node numbers tell apart what was decided so far."""

    length: np.ndarray
    first: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    def __post_init__(self) -> None:
        number = np.arange(len(self.node)) - np.repeat(self.first, self.length)
        #: Node, bit, and which bit of the symbol it is (the third stands for all later ones), in one number.
        self.told = (self.node | self.bit.astype(np.uint32) << 8 | np.minimum(number, 2).astype(np.uint32) << 9).astype(np.uint16)

    @classmethod
    def of(cls, pairs: np.ndarray) -> Code:
        """From counts of [symbol before, symbol]; what was rarely seen follows the counts of single symbols."""
        single = pairs.sum(axis=0)
        share = (single + 1) / (single.sum() + END + 1)
        length, node, bit = [], [], []
        for row in pairs:
            for nodes, bits in cls._paths(row + share * 16):
                length.append(len(nodes))
                node += nodes
                bit += bits
        size = np.array(length, np.int32)
        return cls(size, np.r_[0, np.cumsum(size)[:-1]].astype(np.int32), np.array(node, np.uint32), np.array(bit, np.int8))

    @staticmethod
    def _paths(weights: np.ndarray) -> list[tuple[list[int], list[int]]]:
        heap = [(w, s) for s, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        inner: list[tuple[int, int]] = []
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a + b, END + 1 + len(inner)))
            inner.append((left, right))
        paths: list = [None] * (END + 1)
        todo = [(heap[0][1], [], [])]
        while todo:
            at, nodes, bits = todo.pop()
            if at <= END:
                paths[at] = (nodes, bits)
            else:
                for bit, child in enumerate(inner[at - END - 1]):
                    todo.append((child, [*nodes, at - END - 1], [*bits, bit]))
        return paths

    def bits(self, before: np.ndarray, symbols: np.ndarray, slots: np.ndarray, known: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bits of each symbol; of each bit its slots, what is told of its place, and its symbol's known).

        The slots of one context and symbol lie side by side, by the number of the code's node.
        """
        pair = before.astype(np.intp) * (END + 1) + symbols
        count = self.length.take(pair).astype(np.intp)
        row = np.empty((len(pair), 2), np.int64)
        row[:, 0] = slots
        row[:, 1] = self.first.take(pair)
        row[:, 1] -= np.cumsum(count) - count - (1 << KNOWN_AT - 1)
        row[:, 1] += known << KNOWN_AT
        row = np.repeat(row, count, axis=0)
        spot = row[:, 1] & ((1 << KNOWN_AT) - 1)
        spot += np.arange(-(1 << KNOWN_AT - 1), len(spot) - (1 << KNOWN_AT - 1))
        told = self.told.take(spot)
        at = (told & np.uint16(255)).astype(np.int64)
        at *= ALL_SLOTS
        at += row[:, 0]
        return count, at, told, row[:, 1] >> KNOWN_AT


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if len(_POWERS[0]) <= n:
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, base)], dtype=np.uint64) for base in (_BASE, _BASE_INVERSE)]
    return _POWERS


def contexts(symbols: np.ndarray, starts: np.ndarray, carry: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The symbol before each, a 32-bit hash for each predictor of what stands before it in its own text, and the word's hash.

    carry: the hash of the word so far at each start, where the rows go on with texts that began earlier.
    """
    n, found = len(symbols), []
    past, mixed = symbols.astype(np.uint32) + np.uint32(1), np.zeros(n, np.uint32)
    named = past
    for back in range(1, max(BACK) + 1):
        moved = np.empty_like(past)
        moved[1:] = past[:-1]
        moved[starts] = END + 1
        past = moved
        mixed ^= past
        mixed *= np.uint32(0x01000193)
        mixed += np.uint32(0x3C6EF372)
        if back == 1:
            last = past - np.uint32(1)
        if back in BACK:
            found.append(mixed.copy())
    # the word so far: a polynomial of its symbols, as a difference of running sums
    forward, power = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(named * power[:n], out=sums[1:])
    begins = np.flatnonzero(_SPACE.take(last))  # also where texts begin
    below = sums[begins]
    if carry is not None and carry.any():
        below[np.searchsorted(begins, starts)] -= carry * power[starts]
    word = sums[:n] - np.repeat(below, np.diff(begins, append=n))
    word *= forward[:n]
    found.append((word >> np.uint64(32)).astype(np.uint32) ^ last * np.uint32(0x7F4A7C15))
    return last.astype(np.int16), found, word


def _slots(contexts: list[np.ndarray]) -> np.ndarray:
    """The slots of a symbol's contexts in one number; the code's nodes count from there."""
    slots = np.zeros(len(contexts[0]), np.int64)
    for context, width, shift in zip(contexts, TABLES, SHIFTS):
        slots |= ((context * np.uint32(0x85EBCA6B)) >> np.uint32(32 - width)).astype(np.int64) << shift
    return slots


def _slot(slots: np.ndarray, k: int) -> np.ndarray:
    return slots >> SHIFTS[k] & ((1 << TABLES[k]) - 1)


def _windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Texts sorted by falling length, PIECE symbols of each at a time: symbols, those before, hashes, places, texts.

    A piece begins with the symbols that its contexts reach back to, whose places are below its own first one, and
    with the hash of the word that it goes on with; so its contexts are those of the whole text.
    """
    carry = np.zeros(len(texts), np.uint64)
    for at in range(0, len(texts[0]) + 1, PIECE):
        live, lead = sum(len(t) + 1 > at for t in texts), max(0, at - max(BACK))
        sizes = np.array([min(len(t) + 1, at + PIECE) - lead for t in texts[:live]])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        symbols = np.full(int(sizes.sum()), END, np.int16)
        for text, s in zip(texts, starts.tolist()):
            part = text[lead : at + PIECE]
            symbols[s : s + len(part)] = np.frombuffer(part, np.uint8)
        before, hashes, word = contexts(symbols, starts, carry[:live])
        ahead = at + PIECE - max(BACK) - lead  # where the next piece will begin
        more = sizes > ahead
        carry[:live][more] = word[starts[more] + ahead]
        place = np.arange(len(symbols), dtype=np.int32) - np.repeat((starts - lead).astype(np.int32), sizes)
        doc = np.repeat(np.arange(live, dtype=np.int32), sizes)
        new = place >= at if at else slice(None)
        yield symbols[new], before[new], [h[new] for h in hashes], place[new], doc[new]


# ---- counting


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _groups(texts: list[bytes], most: int = TOGETHER) -> Iterator[list[int]]:
    """Indices of texts of like length, in groups of about so many bytes."""
    group, held = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if group and held + len(texts[i]) > most:
            yield group
            group, held = [], 0
        group.append(i)
        held += len(texts[i]) + 1
    if group:
        yield group


def pair_counts(train: DataFrame) -> np.ndarray:
    """How often each symbol follows each; the end stands for what is before a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((END + 1) ** 2, np.int64)
        for batch in slices(batches, "text"):
            texts, last = _encoded(batch.column("text").to_pylist()), END
            joined, ends = b"\0".join([*texts, b""]), np.cumsum([len(t) + 1 for t in texts]) - 1
            for at in range(0, len(joined), 1 << 20):
                symbols = np.frombuffer(joined[at : at + (1 << 20)], np.uint8).astype(np.intp)
                symbols[ends[slice(*np.searchsorted(ends, [at, at + len(symbols)]))] - at] = END
                total += np.bincount(np.r_[last, symbols[:-1]] * (END + 1) + symbols, minlength=len(total))
                last = symbols[-1]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["pair", "n"])

    found = np.zeros((END + 1) ** 2, np.int64)
    for row in train.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        found[row.pair] = row.n
    return found.reshape(END + 1, END + 1)


def log_odds(train: DataFrame, code: Code) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """The predictors' tables of log odds, in steps, from counts over the rows of train (text, half): of each half, and of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[bool, list[np.ndarray]] = {}
        for batch in batches:
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for flag in (False, True):
                for part in slices([batch.filter(pa.array(half == flag))], "text"):
                    mine = tables.setdefault(flag, [np.zeros(2 << width, np.int32) for width in TABLES])
                    add_bits(mine, _encoded(part.column("text").to_pylist()))
        for flag, mine in tables.items():
            for number, table in enumerate(mine):
                blocks = table.reshape(-1, 2 * BLOCK_SLOTS)
                for at in range(0, len(blocks), 16):
                    part = blocks[at : at + 16]
                    there = [i for i, b in enumerate(part) if b.any()]
                    beyond = [np.flatnonzero(part[i] > 255).astype(np.int32) for i in there]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number] * len(there), pa.int32()), pa.array([at + i for i in there], pa.int32()), pa.array([flag] * len(there), pa.bool_()), pa.array([np.minimum(part[i], 255).astype(np.uint8).tobytes() for i in there], pa.binary()),
                            pa.array([x.tobytes() for x in beyond], pa.binary()), pa.array([(part[i][x] - 255).tobytes() for i, x in zip(there, beyond)], pa.binary()),
                        ],
                        names=["number", "block", "half", "counts", "places", "more"],
                    )

    def add_bits(tables: list[np.ndarray], texts: list[bytes]) -> None:
        for group in _groups(texts, NEAR):
            for symbols, before, hashes, _, _ in _windows([texts[i] for i in group]):
                _, slots, told, _ = code.bits(before, symbols, _slots(hashes))
                bit = (told >> np.uint16(8) & np.uint16(1)).astype(np.int64)
                for k, table in enumerate(tables):
                    np.add.at(table, _slot(slots, k) << 1 | bit, np.int32(1))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros((2, 0), np.int64)

        def row() -> pa.RecordBatch:
            odds = [np.clip(np.rint(np.log((n[1::2] + 0.4) / (n[::2] + 0.4)) / STEP), -127, 127).astype(np.int8).tobytes() for n in (*total, total.sum(axis=0))]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *[pa.array([o], pa.binary()) for o in odds]], names=["number", "block", "first", "second", "every"])

        for batch in batches:
            for number, block, half, counts, places, more in zip(*(batch.column(i) for i in range(6))):
                now = (number.as_py(), block.as_py())
                if now != key:
                    if key is not None:
                        yield row()
                    key, total = now, np.zeros((2, 2 * BLOCK_SLOTS), np.int64)
                mine = total[int(half.as_py())]
                mine += np.frombuffer(counts.as_buffer(), np.uint8)
                mine[np.frombuffer(places.as_py(), np.int32)] += np.frombuffer(more.as_py(), np.int32)
        if key is not None:
            yield row()

    counted = train.mapInArrow(count, "number int, block int, half boolean, counts binary, places binary, more binary")
    summed = counted.repartition("number", "block").sortWithinPartitions("number", "block").mapInArrow(add, "number int, block int, first binary, second binary, every binary")
    found = [[np.zeros(1 << width, np.int8) for width in TABLES] for _ in range(3)]
    for r in summed.toLocalIterator():  # as many rows and bytes whatever the corpus
        for tables, odds in zip(found, (r.first, r.second, r.every)):
            tables[r.number][r.block * BLOCK_SLOTS : (r.block + 1) * BLOCK_SLOTS] = np.frombuffer(bytes(odds), np.int8)
    return found[0], found[1], found[2]


# ---- mixing


@dataclass
class Mixer:
    code: Code
    tables: list[np.ndarray]
    weights: np.ndarray

    @classmethod
    def start(cls, code: Code, tables: list[np.ndarray]) -> Mixer:
        return cls(code, tables, np.full((len(TABLES), GATES), 0.4 * STEP, np.float32))

    def costs(self, texts: list[bytes]) -> list[np.ndarray]:
        """The cost of every symbol of each text in nats; weights are in steps of the log odds."""
        found: list = [None] * len(texts)
        for group in _groups(texts):
            own = [texts[i] for i in group]
            deltas = np.zeros((len(TABLES), len(own)), np.float32)
            for i, t in zip(group, own):
                found[i] = np.empty(len(t) + 1, np.float32)
            for window in _windows(own):
                self._piece(window, deltas, [found[i] for i in group])
        return found

    def inputs(self, symbols: np.ndarray, before: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The number of bits of each symbol; of each bit the gate, and of each predictor the log odds of what came true."""
        head = slots + ROOT * ALL_SLOTS  # of a symbol's first bit
        known = [self.tables[k].take(_slot(head, k)) != 0 for k in (1, 2)]
        many, at, told, known = self.code.bits(before, symbols, slots, known[0] * np.int64(3) + known[1] * np.int64(6))
        sign = (told >> np.uint16(7) & np.uint16(2)).astype(np.int8) - np.int8(1)
        known += told >> np.uint16(9)
        return many, known, [t.take(_slot(at, k)) * sign for k, t in enumerate(self.tables)]

    def _piece(self, window: tuple, deltas: np.ndarray, found: list[np.ndarray]) -> None:
        """The costs of a piece's symbols; blocks of EVERY symbols of all its texts go one after the other."""
        symbols, before, hashes, place, doc = window
        step = place // EVERY
        begins = np.r_[0, np.flatnonzero((step[1:] != step[:-1]) | (doc[1:] != doc[:-1])) + 1]
        turn = np.argsort(step[begins], kind="stable")
        sizes = np.diff(begins, append=len(step))[turn]
        runs = np.r_[0, np.cumsum(sizes)]
        order = np.repeat(begins[turn] - runs[:-1], sizes) + np.arange(len(step))
        symbols, before, slots = symbols.take(order), before.take(order), _slots(hashes).take(order)
        run_cuts = np.r_[0, np.flatnonzero(np.diff(step[begins][turn])) + 1, len(turn)].tolist()
        cuts = runs[run_cuts].tolist()
        costs, n, i = np.empty(len(order), np.float32), len(cuts) - 1, 0
        by_gate = np.zeros((GATES, len(TABLES) + 1), np.float32)  # sixteen bytes a row are taken at once
        by_gate[:, :-1] = self.weights.T
        while i < n:  # as many blocks at a time as make about NEAR bits
            j = i + 1
            while j < n and cuts[j + 1] - cuts[i] <= NEAR >> 3:
                j += 1
            a, b = cuts[i], cuts[j]
            many, gate, signed = self.inputs(symbols[a:b], before[a:b], slots[a:b])
            odds = [o.astype(np.float32) for o in signed]
            ends = np.cumsum(many)
            offsets = np.r_[(ends - many)[runs[run_cuts[i] : run_cuts[j]] - a], ends[-1]]
            y = np.zeros(len(gate), np.float32)  # what the weights give; the text's own changes come on top
            mixed = by_gate.take(gate, axis=0)
            for k, o in enumerate(odds):
                y += mixed[:, k] * o
            for block in range(i, j):
                own = offsets[run_cuts[block] - run_cuts[i] : run_cuts[block + 1] - run_cuts[i] + 1]
                lo, hi, live = int(own[0]), int(own[-1]), len(own) - 1  # the longer texts come first, so those that go on are the first ones
                cost, mine = y[lo:hi], [o[lo:hi] for o in odds]
                bits = np.diff(own)
                for k, o in enumerate(mine):
                    cost += np.repeat(deltas[k, :live], bits) * o
                np.clip(cost, -16, 16, out=cost)
                np.negative(cost, out=cost)
                e = np.exp(cost)
                np.add(e, np.float32(1), out=cost)
                e /= cost
                for k, o in enumerate(mine):
                    deltas[k, :live] += np.float32(OWN_RATE * STEP * STEP) * np.add.reduceat(o * e, own[:-1] - lo)
            # sums by symbol, of whole numbers, so that they do not depend on what stands beside
            total = np.cumsum((np.log(y, out=y) * np.float32(1 << 40)).astype(np.int64))[ends - 1]
            costs[a:b] = np.diff(total, prepend=0) * 2.0**-40
            i = j
        back = np.empty_like(costs)
        back[order] = costs
        at = int(place[0])
        cuts = np.r_[0, np.cumsum(np.bincount(doc))].tolist()
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            found[i][at : at + b - a] = back[a:b]

    def tally(self, texts: list[bytes]) -> np.ndarray:
        """How many of the texts' bits there are by gate and by the levels of their log odds."""
        n = len(LEVEL)
        total, pending, held = np.zeros(GATES * n ** len(TABLES), np.int64), [], 0
        for group in _groups(texts, NEAR):
            for symbols, before, hashes, _, _ in _windows([texts[i] for i in group]):
                _, gate, odds = self.inputs(symbols, before, _slots(hashes))
                cell = gate.astype(np.int32)
                for o in odds:
                    cell *= np.int32(n)
                    cell += np.frombuffer(o.tobytes().translate(_LEVELS), np.uint8)
                pending.append(cell)
                held += len(cell)
                if held > 1 << 21:
                    total += np.bincount(np.concatenate(pending), minlength=len(total))
                    pending, held = [], 0
        return total + np.bincount(np.concatenate(pending), minlength=len(total)) if pending else total


def tallied(train: DataFrame, code: Code, first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """[gate, level, level, level] counts of the bits of all rows of train (text, half), each half read with the other's tables."""
    sent = train.sparkSession.sparkContext.broadcast((Mixer.start(code, second), Mixer.start(code, first)))
    size = GATES * len(LEVEL) ** len(TABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, "text"):
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for flag, mixer in enumerate(sent.value):
                total += mixer.tally(_encoded(batch.filter(pa.array(half == flag)).column("text").to_pylist()))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["cell", "n"])

    found, counts = train.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow(), np.zeros(size, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    sent.unpersist()
    return counts.reshape(GATES, *[len(LEVEL)] * len(TABLES))


def learned(counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The weights, in steps, that Newton's method finds on the cost of the bits that were tallied."""
    k = len(TABLES)
    weights = np.full((k, GATES), 0.4)
    for g in range(GATES):
        there = np.nonzero(counts[g])
        n, x = counts[g][there].astype(np.float64), LEVEL[np.stack(there)] * STEP
        for _ in range(rounds):
            share = 1 / (1 + np.exp(np.clip(weights[:, g] @ x, -16, 16)))
            bend = (x * (n * share * (1 - share))) @ x.T + np.eye(k) * 4  # little seen, little moved
            weights[:, g] += np.clip(np.linalg.solve(bend, x @ (n * share)), -0.5, 0.5)
    return (weights * STEP).astype(np.float32)


def fit(docs: DataFrame, key: str, text: str, fold: Column, modulus: int) -> Mixer:
    """Learn from all rows whose fold (0 to modulus - 1) is not 0."""
    rows = docs.select(F.col(text).alias("text"), fold.alias("fold"))
    train = rows.where("fold <> 0").select("text", (F.pmod(F.xxhash64("text"), F.lit(2)) == 1).alias("half"))
    code = Code.of(pair_counts(train.select("text")))
    first, second, every = log_odds(train, code)
    return Mixer(code, every, learned(tallied(train, code, first, second)))


# ---- what the corpus says of tokens and segments, and all together


def _items(words: pa.Array) -> list[bytes]:
    """As to_pylist, without a scalar for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(contexts: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """One number for a pair."""
    return _mixed(contexts * np.uint64(3) + segments)


@dataclass
class Chunk:
    """Texts with their tokens, and their segments: text, symbols, and the pair of the segment before and this one."""

    tokens: list[bytes]
    ids: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    doc: np.ndarray
    symbols: np.ndarray
    pair: np.ndarray
    contexts: np.ndarray
    segments: np.ndarray
    pair_counts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, train: np.ndarray) -> Chunk:
        """From strings, without nulls, and which of them are training rows."""
        n = len(texts)
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat, owner = words.flatten(), pc.list_parent_indices(words).to_numpy()
        there = pc.greater(pc.binary_length(flat), 0)
        flat, owner = flat.filter(there), owner[there.to_numpy(zero_copy_only=False)]
        coded = flat.dictionary_encode()
        ids, tokens = coded.indices.to_numpy().astype(np.int64), _items(coded.dictionary.cast(pa.binary()))
        sizes = np.bincount(owner, minlength=n) + 1
        counts = np.bincount(ids[train[owner]], minlength=len(tokens))
        # segments end with their text, or at words whose hash says so
        cut = pc.split_pattern(texts, " ")
        raw = cut.flatten().dictionary_encode()
        place, doc = raw.indices.to_numpy().astype(np.int64), pc.list_parent_indices(cut).to_numpy()
        kinds = raw.dictionary.cast(pa.binary())
        hashes = _hashes(_items(kinds), len(kinds))
        last = np.r_[doc[1:] != doc[:-1], True]
        ends = np.flatnonzero((hashes % np.uint64(SEGMENT) == 0)[place] | last)
        begins = np.r_[0, ends[:-1] + 1]
        inside = np.arange(len(place)) - np.repeat(begins, ends - begins + 1)
        names = _mixed(np.add.reduceat(_mixed(hashes[place] + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begins) + last[ends])
        symbols = np.add.reduceat((pc.binary_length(kinds).to_numpy().astype(np.int64) + 1)[place], begins)
        of = doc[ends]
        follows = np.flatnonzero(np.r_[False, of[1:] == of[:-1]])
        before, after = names[follows - 1], names[follows]
        _, first, which = np.unique(_joined(before, after), return_index=True, return_inverse=True)
        pair = np.full(len(ends), -1)
        pair[follows] = which
        seen = np.bincount(which[train[of[follows]]], minlength=len(first))
        return cls(tokens, ids, sizes, counts, of, symbols, pair, before[first], after[first], seen)

    def dealt(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, tokens, pairs) that belong to it, by number."""
        n = np.uint64(buckets)
        sides = []
        for bucket in ((_hashes(self.tokens, len(self.tokens)) % n).astype(np.int64), (self.contexts % n).astype(np.int64)):
            order = np.argsort(bucket, kind="stable")
            there, cuts = np.unique(bucket[order], return_index=True)
            sides.append({int(b): order[x:y] for b, x, y in zip(there, cuts, [*cuts[1:], len(order)])})
        none = np.zeros(0, np.int64)
        for b in sorted(sides[0].keys() | sides[1].keys()):
            yield b, sides[0].get(b, none), sides[1].get(b, none)


_SENT = "bucket long, chunk long, tokens binary, counts binary, contexts binary, segments binary, pairs binary"


def _read(table: pa.Table, at: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    of = lambda name, kind: np.frombuffer(table.column(name)[at].as_buffer(), kind)
    counts = of("counts", np.int64)
    tokens = table.column("tokens")[at].as_py().split(b"\n") if len(counts) else []
    return tokens, counts, of("contexts", np.uint64), of("segments", np.uint64), of("pairs", np.int64)


def _summed(contexts: np.ndarray, segments: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by pair, in the order of contexts, and of counts from the greatest, and of segments."""
    order = np.lexsort((segments, contexts))
    contexts, segments, n = contexts[order], segments[order], n[order]
    new = np.flatnonzero(np.r_[True, (contexts[1:] != contexts[:-1]) | (segments[1:] != segments[:-1])]) if len(n) else np.zeros(0, np.int64)
    return contexts[new], segments[new], np.add.reduceat(n, new) if len(n) else n


class Totals:
    """What a bucket's tokens and pairs come to."""

    def __init__(self) -> None:
        self.tokens: dict[bytes, int] = {}
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, tokens: list[bytes], counts: np.ndarray, contexts: np.ndarray, segments: np.ndarray, pairs: np.ndarray) -> None:
        found = self.tokens
        for token, n in zip(tokens, counts.tolist()):
            if n:
                found[token] = found.get(token, 0) + n
        there = pairs > 0
        self.pending.append((contexts[there], segments[there], pairs[there]))
        self.held += int(there.sum())
        if self.held > 1 << 21:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = _summed(*(np.concatenate(x) for x in zip(*self.pending))) if self.pending else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.pending, self.held = [whole], 0
        return whole


class Known:
    """A bucket's totals, to be asked."""

    def __init__(self, tokens: dict[bytes, int], contexts: np.ndarray, segments: np.ndarray, n: np.ndarray):
        self.tokens = tokens
        self.contexts, self.segments, self.n = contexts, segments, n
        self.keys = _joined(contexts, segments)
        self.order = np.argsort(self.keys)
        self.first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(n) else np.zeros(0, np.int64)
        self.best = np.maximum.reduceat(n, self.first) if len(n) else n
        group = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(n)]))
        top = np.flatnonzero(n == self.best[group]) if len(n) else np.zeros(0, np.int64)
        _, where = np.unique(group[top], return_index=True)
        self.leader = top[where]  # of equals the smallest segment
        rest = n.copy()
        rest[self.leader] = 0
        self.second = np.maximum.reduceat(rest, self.first) if len(n) else n

    def counts_of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter((self.tokens.get(t, 0) for t in tokens), np.int64, len(tokens))

    def pairs_of(self, contexts: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each pair was seen, and how often the likeliest other segment behind the same one."""
        if not len(self.n) or not len(contexts):
            return np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        keys = _joined(contexts, segments)
        at = self.order[np.minimum(np.searchsorted(self.keys, keys, sorter=self.order), len(self.order) - 1)]
        same = (self.contexts[at] == contexts) & (self.segments[at] == segments)
        own = np.where(same, self.n[at], 0)
        heads = self.contexts[self.first]
        g = np.minimum(np.searchsorted(heads, contexts), len(heads) - 1)
        other = np.where(same & (self.leader[g] == at), self.second[g], self.best[g])
        return own, np.where(heads[g] == contexts, other, 0)


def replies_to(sent: DataFrame) -> DataFrame:
    """(chunk, bucket, counts, own, other, n, v): to each row that was sent, what its tokens and pairs come to, in its order.

    n and v, on one row of a bucket, are the sum and the number of its tokens' counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["bucket"]):
            total, found = Totals(), [_read(rows, i) for i in range(rows.num_rows)]
            for x in found:
                total.add(*x)
            known = Known(total.tokens, *total.settle())
            n, v = [0] * len(found), [0] * len(found)
            n[0], v[0] = sum(total.tokens.values()), len(total.tokens)
            pairs = [known.pairs_of(x[2], x[3]) for x in found]
            columns = [[known.counts_of(x[0]).tobytes() for x in found], *[[y[i].astype(np.int32).tobytes() for y in pairs] for i in range(2)]]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(rows.column(c).to_pylist(), pa.int64()) for c in ("chunk", "bucket")], *[pa.array(c, pa.binary()) for c in columns], pa.array(n, pa.int64()), pa.array(v, pa.int64())],
                names=["chunk", "bucket", "counts", "own", "other", "n", "v"],
            )

    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(run, "chunk long, bucket long, counts binary, own binary, other binary, n long, v long"), "replies")


def event_cost(costs: np.ndarray, own: np.ndarray, other: np.ndarray) -> float:
    """The cost of a text by its segments' symbols and what other texts have behind the segment before each.

    own counts this continuation, other the likeliest of the rest; both 0 where nothing is known.
    """
    total, hits, misses = float(costs.sum()), 0.0, 0.0
    for i in np.flatnonzero((own > 0) | (other > 0)).tolist():
        came = own[i] > other[i]
        a, b = START[min(int(own[i] if came else other[i]), LEVELS) - 1]
        p = (a + hits) / (a + b + hits + misses)
        plain = float(costs[i])
        total += (-log(p + (1 - p) * exp(-plain)) if came else plain - log(1 - p)) - plain
        hits, misses = 0.9 * hits + came, 0.9 * misses + (not came)
    return total


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 10, chunk_bytes: int = 4 << 20, mixer: Mixer | None = None) -> DataFrame:
    """(key, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Rows whose key's CRC-32 is a multiple of modulus are held out; the model learns from the others.
    """
    spark, fold = docs.sparkSession, crc_mod(key, modulus)
    mixer = mixer or fit(docs, key, text, fold, modulus)
    size, rows, trained = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*"), F.count_if(fold != 0)).first()
    chunks = max(1, ceil((size + 64 * rows) / chunk_bytes))
    buckets = ceil(chunks / 8)
    placed = with_uid(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold != 0).alias("train")), "uid")
    dealt = placed.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)))

    def of(group: pa.Table) -> tuple[pa.Table, Chunk]:
        group = group.take(pc.sort_indices(group.column("uid")))  # both passes number tokens alike
        return group, Chunk.of(group.column("text").combine_chunks(), group.column("train").to_numpy().astype(bool))

    def local(group: pa.Table) -> pa.Table:
        group, own = of(group)
        chunk, tokens, rows = group.column("chunk")[0].as_py(), own.tokens, list(own.dealt(buckets))
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "tokens": pa.array([b"\n".join([tokens[i] for i in t.tolist()]) for _, t, _ in rows], pa.binary()),
                **{name: pa.array([values[at].tobytes() for at in ats], pa.binary()) for name, values, ats in (
                    ("counts", own.counts, [t for _, t, _ in rows]), ("contexts", own.contexts, [p for _, _, p in rows]), ("segments", own.segments, [p for _, _, p in rows]), ("pairs", own.pair_counts, [p for _, _, p in rows]),
                )},
            }
        )

    replies = replies_to(dealt.select("uid", "text", "train", "chunk").groupBy("chunk").applyInArrow(local, _SENT))
    n, v = replies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    total, kinds = n + trained, v + (trained > 0)
    below = log(total + 0.1 * (kinds + 1)) / log(10)
    carried = spark.sparkContext.broadcast((mixer.code, mixer.tables, mixer.weights))
    out = docs.select(F.col(key).alias("key"), F.lit(True).alias("held_out"), *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_tokens", "n_known", "train_tokens")], *[F.lit(0.0).alias(c) for c in ("base_score", "score", "bits_per_byte")])
    names = out.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (left.column("key").type, pa.bool_(), *[pa.int64()] * 4, *[pa.float64()] * 3)], names=names)
        group, own = of(left)
        train = group.column("train").to_numpy().astype(bool)
        answers = {b: (c, o, x) for b, c, o, x in zip(right.column("bucket").to_pylist(), right.column("counts"), right.column("own"), right.column("other"))}
        counts, seen, other = np.zeros(len(own.tokens) + 1, np.int64), np.zeros(len(own.contexts) + 1, np.int64), np.zeros(len(own.contexts) + 1, np.int64)
        counts[-1] = trained
        for b, t, p in own.dealt(buckets):
            c, o, x = answers[b]
            counts[t] = np.frombuffer(c.as_buffer(), np.int64)
            seen[p], other[p] = np.frombuffer(o.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.int32)
        starts = np.cumsum(own.sizes) - own.sizes
        at = np.full(int(own.sizes.sum()), len(own.tokens))
        at[np.delete(np.arange(len(at)), starts + own.sizes - 1)] = own.ids
        base = np.add.reduceat((np.log10(counts + 0.1) - below)[at], starts)
        known = np.add.reduceat((counts > 0)[at].astype(np.int64), starts)
        encoded = group.column("text").cast(pa.binary()).to_pylist()
        symbols = Mixer(*carried.value).costs(encoded)
        # a training text's own segments are not what others have
        _, which = np.unique(own.doc * (len(own.contexts) + 1) + own.pair, return_inverse=True)
        times = np.bincount(which)[which] * train[own.doc]
        seen_here, other_here = np.maximum(seen[own.pair] - times, 0), other[own.pair].copy()
        seen_here[own.pair < 0] = other_here[own.pair < 0] = 0
        cuts = np.searchsorted(own.doc, np.arange(group.num_rows + 1)).tolist()
        per = np.add.reduceat(np.concatenate(symbols).astype(np.float64), np.cumsum(own.symbols) - own.symbols)
        cost = np.array([event_cost(per[a:b], seen_here[a:b], other_here[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
        length = np.array([len(t) for t in encoded], np.int64)
        return pa.table(
            [
                group.column("key"), pa.array(~train), pa.array(length), pa.array(own.sizes.astype(np.int64)), pa.array(known), pa.array([total] * group.num_rows, pa.int64()),
                pa.array(base), pa.array(np.round(-cost / log(10), 3)), pa.array(np.round(cost / log(2) / np.maximum(length, 1), 4)),
            ],
            names=names,
        )

    found = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, out.schema)
    return found.withColumnRenamed("key", key)
