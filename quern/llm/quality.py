"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, the shapes of its tokens (runs of letters, capitals and digits as one, other characters
as they are) and marks of its make-up: how long it is, how often lines and words repeat and follow themselves, how long
its words and lines are.  Terms are hashed to a fixed number of columns, weighted by log frequency and by inverse
document frequency over all documents, each kind brought to one length, so that many words do not drown a few marks, and
turned into latent-semantic vectors by a truncated singular value decomposition.  Every text's cosines with all
labelled vectors are exact, computed in blocks; the labels of the nearest vote, weighted by similarity.

Weights, axes and vectors are rounded to whole numbers, small enough that sums of their products are exact in 64-bit
floats.  So a text's score does not depend on the texts that it is computed with; of equal cosines the labelled row
that comes first, by key and text, is the nearer one.

fit() takes a bounded sample of labelled rows, chosen by hash, so the vectors that are sent to the executors have a
known bound; document frequencies are those of all rows.

Defined cases: null and empty texts have the terms of an empty text and are scored like any other; labels without a
text, null labels and null keys teach nothing; several labels of a key count by their mean, of several texts of a key
the least is taken; without any label every score is 0.5; repeated rows stay repeated; equal texts score the same; a
very long text is one row's work; where docs has a column of the new one's name, underscores are put behind the latter;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p, log2
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, slices

#: Labelled rows of the fit, hashed columns of shapes and marks and of words, latent dimensions, and neighbours that vote.
SAMPLE, COLUMNS, WORDS, DIMENSIONS, NEIGHBOURS = 4000, 1024, 4096, 64, 25
#: Length of a text's words beside that of its shapes and marks, and how sharply votes fall with the cosine.
WORD_SHARE, SHARP = 0.3, 16
#: Whole numbers that stand for 1 in weights, axes and vectors.
_WEIGHT, _AXIS, _UNIT = 1 << 15, 1 << 20, 1 << 14
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_BLOCK = 512


def terms(text: str | None) -> dict[bytes, float]:
    """The terms of a text other than its words, and their counts."""
    body = text.encode("utf-8", "surrogatepass") if text else b""
    shape = body.translate(_SHAPE)
    for run in (b"aa", b"AA", b"00"):
        while run in shape:
            shape = shape.replace(run, run[:1])
    tokens, words = Counter(shape.split()), body.lower().split()
    lines = [x for x in body.split(b"\n") if x.strip()]
    n, found = len(words), dict(tokens)
    size = int(log2(n + 1))
    kinds = len(set(words))
    found[b"\x00size%d" % size] = 1
    found[b"\x00kinds%d" % (10 * kinds // max(n, 1))] = 1
    found[b"\x00width%d" % (sum(map(len, words)) // max(n, 1))] = 1
    found[b"\x00line%d" % int(log2(n / max(len(lines), 1) + 1))] = 1
    again = len(lines) - len(set(lines))
    found[b"\x00again%d" % (10 * again // max(len(lines), 1))] = 1
    if len(lines) > 3:
        found[b"\x00often%d" % (10 * Counter(lines).most_common(1)[0][1] // len(lines))] = 1
    same = sum(map(eq, words, words[1:]))
    found[b"\x00same%d" % (-(-10 * same // max(n, 1)))] = 1
    odd = len(re.findall(rb"[^\w\s.,;:'\x80-\xff-]", body))
    found[b"\x00odd%d" % int(10 * min(1, odd / max(n, 1)))] = 1
    return found


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a text's terms, rising, and their log frequencies."""
    row: dict[int, float] = {}
    for term, n in terms(text).items():
        at = zlib.crc32(term) % COLUMNS
        row[at] = row.get(at, 0.0) + log1p(n)
    if text:
        for word, n in Counter(text.encode("utf-8", "surrogatepass").lower().split()).items():
            at = COLUMNS + zlib.crc32(word) % WORDS
            row[at] = row.get(at, 0.0) + log1p(n)
    at = np.fromiter(row, np.int64, len(row))
    order = np.argsort(at)
    return at[order], np.fromiter(row.values(), np.float64, len(row))[order]


@dataclass
class Model:
    inverse: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def weighted(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and weights, in whole steps: shapes and marks have length 1 together, words WORD_SHARE."""
        at, values = found
        x = values * self.inverse[at]
        cut = int(np.searchsorted(at, COLUMNS))
        for part, share in ((x[:cut], 1.0), (x[cut:], WORD_SHARE)):
            part *= share / max(float(np.sqrt((part * part).sum())), 1e-9)
        return at, np.rint(x * _WEIGHT)

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Latent vectors of one length, in whole steps."""
        x = np.stack([w @ self.axes[at] for at, w in map(self.weighted, rows)]) if rows else np.zeros((0, self.axes.shape[1]))
        return np.rint(x * (_UNIT / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The share of label 1 in the neighbours' votes, each a power of its cosine."""
        n = len(self.labels)
        if not n:
            return np.full(len(texts), 0.5)
        found, k = [], min(self.neighbours, n)
        for at in range(0, len(texts), _BLOCK):
            steps = self.project([hashed(t) for t in texts[at : at + _BLOCK]]) @ self.vectors.T
            near = np.argpartition(np.arange(n) - steps * n, k - 1, axis=1)[:, :k]  # whole numbers, no two alike
            near.sort(axis=1)
            weight = np.exp(SHARP * (np.take_along_axis(steps, near, axis=1) / _UNIT**2 - 1))
            found.append((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1))
        return np.round(np.concatenate(found), 6) if found else np.zeros(0)


def decomposed(rows: list[tuple[np.ndarray, np.ndarray]], columns: int, dimensions: int, rounds: int = 4) -> np.ndarray:
    """[column, dimension] greatest right singular vectors of sparse rows, by subspace iteration."""
    x = np.zeros((len(rows), columns))
    for i, (at, values) in enumerate(rows):
        x[i, at] = values / _WEIGHT
    found = np.random.default_rng(1).standard_normal((columns, min(dimensions, *x.shape) + 8))
    for _ in range(rounds):
        found, _ = np.linalg.qr(x.T @ (x @ np.linalg.qr(found)[0]))
    small, _, turn = np.linalg.svd(x @ found, full_matrices=False)
    return (found @ turn.T)[:, :dimensions]


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have a term of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(COLUMNS + WORDS, np.int64), 0
        for batch in slices(batches, "text"):
            for x in batch.column("text").to_pylist():
                total[hashed(x)[0]] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(np.r_[n, total])], names=["at", "n"])

    out = np.zeros(COLUMNS + WORDS + 1, np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each column
        out[r["at"] + 1] = r.n
    return int(out[0]), out[1:]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", train: Column | None = None, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> Model:
    """Learn from at most about `sample` labelled rows that `train`, a condition on the key, lets in."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (train if train is not None else F.lit(True))).groupBy(F.col(key).alias("k")).agg(F.avg(label).alias("y"))
    n = marked.count()
    unit = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chosen = marked.where(unit < min(1.0, sample / max(n, 1)))  # about `sample` rows, so it may be sent whole
    got = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").where(F.col("text").isNotNull()).groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [hashed(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k").cast(pa.string()), batch.column("y"), pa.array([at.tobytes() for at, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["k", "y", "at", "values"])

    rows = got.mapInArrow(run, "k string, y double, at binary, values binary").sort("k").collect()
    model = Model(np.ones(COLUMNS + WORDS), np.zeros((COLUMNS + WORDS, 1)), np.zeros((0, 1)), np.array([r.y for r in rows]), neighbours)
    if rows:
        found = [(np.frombuffer(bytes(r["at"]), np.int64), np.frombuffer(bytes(r["values"]))) for r in rows]
        every, seen = document_frequencies(docs, text)
        model.inverse = np.log((1 + every) / (1 + seen)) + 1
        model.axes = np.rint(_AXIS * decomposed([model.weighted(x) for x in found], COLUMNS + WORDS, DIMENSIONS))
        model.vectors = model.project(found)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score; no column but the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name, body = fresh(docs, name, "body")
    source = docs.withColumn(body, F.col(text))
    schema = docs.withColumn(name, F.lit(0.0)).schema
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body):
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], pa.array(sent.value.scores(batch.column(body).to_pylist()))], names=schema.names)

    return source.mapInArrow(run, schema)
