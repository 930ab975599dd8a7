"""SentencePiece encoding and decoding by a forward pass over a trie of the distinct marked words.

A text is marked as the model's normaliser does (identity; a mark in front, marks for spaces) and cut where no piece
can reach across: before a word's marks, and around characters that no piece has.  The distinct words of a batch are
sorted, which lays out their trie in depth-first order: a word keeps the forward states of the prefix that it shares
with the word before and only goes on from there.

The forward state of a prefix is the greatest score of its segmentations and the last piece of the best one.  For a
unigram model a score is the sum of the pieces' scores, as in Viterbi's algorithm.  A BPE model's file orders merges
instead, and the sum of its scores would give other pieces than the model's own; there every two neighbours score 0 if
they stay two pieces when their text alone is merged, and -1 if they do not.  Exactly one segmentation of a prefix has
the greatest possible score, 0: the one that its merges give.  So the search may end at the first last piece, from the
longest on, that scores 0 behind the state of the prefix before it.  Both scores need the shorter prefixes' states
only, so both share them along the trie.  Characters without a piece fall back to bytes.

Decoding joins pieces, reads runs of byte pieces as UTF-8, and turns marks into spaces.  It restores every text
without U+2581, the mark itself, exactly.

The model file is read by the driver, whose pieces (a bounded file) go to the executors; its path is a parameter.

Defined cases: null texts give null; empty texts give no pieces; a word may be as long as a text; repeated rows stay
repeated; other columns stay as they are, and where one has a new column's name, underscores are put behind the latter;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh, slices

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of a model file that may be sent to the executors.
MOST_MODEL = 64 << 20
#: Words whose pieces a worker keeps from batch to batch, and pairs of pieces that it keeps scores of.
CACHE, PAIRS = 120_000, 200_000
#: Bytes of texts that are cut into words at once; words take a multiple of it.
BATCH = 1 << 20


@dataclass
class Pieces:
    """A model's pieces: text to (id, score), ids of bytes, id to text, and whether it is a BPE model."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    texts: dict[int, str]
    unknown: int
    merges: bool
    dummy: bool
    pairs: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.bytes = {i: b for b, i in enumerate(self.byte_ids)}
        self.chars = {c for p in self.ids for c in p if len(p) == 1 or not self.merges}
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in self.chars)
        self.cut = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+") if not crossing else re.compile(r"(?s).+")
        #: Pieces that merges make at all.
        self.whole = {p for p in self.ids if not self.merges or len(p) == 1 or self.merged(p) == [p]}
        #: The pieces' own trie: a node maps a character to the next node, and "" to the piece that ends there.
        self.trie: list = [None, {}]  # the piece that ends at a node, and the next nodes by character
        for p in self.whole:
            node = self.trie
            for c in p:
                node = node[1].setdefault(c, [None, {}])
            node[0] = p
        size = 1 + max([*self.texts, *self.byte_ids, 0])
        self.table = [self.texts.get(i, "") for i in range(size)]
        self.is_byte = np.isin(np.arange(size), self.byte_ids) if self.byte_ids else np.zeros(size, bool)
        self.least = min(self.scores.values(), default=0.0) - 10

    def marked(self, text: str) -> str:
        return (MARK if self.dummy and text else "") + text.replace(" ", MARK)

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text, by the plain rule: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: str, right: str) -> bool:
        """Whether two pieces stay two beside each other."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def forward(self, words: list[str]) -> dict[str, bytes]:
        """The piece ids of each word, as 32-bit numbers."""
        out: dict[str, bytes] = {}
        last: list[str] = [""]  # the last piece of each prefix of the word at hand
        sums: list[float] = [0.0]  # the score of each prefix; a BPE model's are all 0 and not kept
        open_: list[list[tuple[int, list]]] = [[]]  # where pieces begin that may go on after each prefix, longest first
        before, root, known, bytes_of = "", self.trie[1], self.ids, self.byte_ids
        step = self._merge_state if self.merges else self._best_state
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], sums[shared + 1 :], open_[shared + 1 :]
            step(word, shared, last, sums, open_, root)
            before, at, ids = word, len(word), []
            while at:
                piece = last[at]
                found = known.get(piece)
                ids += [found] if found is not None else [bytes_of[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))] if bytes_of else [self.unknown]
                at -= len(piece)
            ids.reverse()
            out[word] = array("i", ids).tobytes()
        return out

    def _merge_state(self, word: str, shared: int, last: list[str], sums: list[float], open_: list, root: dict) -> None:
        """Extend the states of a prefix to the whole word, by the scores of neighbours."""
        pairs, stays = self.pairs, self.stays
        for i in range(shared, len(word)):
            char, now, state = word[i], [], None
            for start, node in open_[i]:
                child = node[1].get(char)
                if child is not None:
                    now.append((start, child))
                    if state is None and (piece := child[0]) is not None:
                        if not start:
                            state = piece
                        else:
                            found = pairs.get((last[start], piece))
                            if found or (found is None and stays(last[start], piece)):
                                state = piece
            child = root.get(char)
            if child is not None:
                now.append((i, child))
            open_.append(now)
            last.append(state or char)

    def _best_state(self, word: str, shared: int, last: list[str], sums: list[float], open_: list, root: dict) -> None:
        """Extend the states of a prefix to the whole word, by sums of scores."""
        for i in range(shared, len(word)):
            char = word[i]
            now = [(start, child) for start, node in open_[i] if (child := node[1].get(char)) is not None]
            if (child := root.get(char)) is not None:
                now.append((i, child))
            open_.append(now)
            best, state = sums[-1] + self.least, char
            for start, node in now:
                one = node[0]
                if one is not None and sums[start] + self.scores[one] > best:
                    best, state = sums[start] + self.scores[one], one
            sums.append(best)
            last.append(state)

    def encode_batch(self, texts: list[str | None], cache: dict[str, bytes]) -> list[bytes | None]:
        """The piece ids of each text, as 32-bit numbers."""
        cut = [None if t is None else self.cut.findall(self.marked(t)) for t in texts]
        new = {w for ws in cut if ws for w in ws}.difference(cache)
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = {w for ws in cut if ws for w in ws}
        cache.update(self.forward(list(new)))
        return [None if ws is None else b"".join(map(cache.__getitem__, ws)) for ws in cut]

    def encode(self, texts: list[str | None], cache: dict[str, bytes] | None = None) -> list[list[int] | None]:
        return [None if x is None else np.frombuffer(x, np.int32).tolist() for x in self.encode_batch(texts, {} if cache is None else cache)]

    def decode(self, ids: Sequence[int] | np.ndarray | None) -> str | None:
        if ids is None:
            return None
        ids = np.asarray(ids, np.int64)
        there = ids[(ids >= 0) & (ids < len(self.table))]
        if not self.is_byte[there].any():
            text = "".join(map(self.table.__getitem__, there.tolist()))
        else:
            out, run = [], bytearray()
            for i in there.tolist():
                if (b := self.bytes.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.table[i])
            if run:
                out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        if self.dummy and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")


def load(path: str = DEFAULT_MODEL) -> Pieces:
    """Read a SentencePiece model file; its normaliser must be the identity that keeps white space."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        data = file.read(MOST_MODEL + 1)
    if len(data) > MOST_MODEL:
        raise ValueError("the model file is too large to be sent to the executors")
    model = proto.ModelProto()
    model.ParseFromString(data)
    rule = model.normalizer_spec
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces:
        raise ValueError("only models with the identity normaliser that keep white space are read")
    ids, scores, byte_ids, texts, unknown = {}, {}, [0] * 256, {}, 0
    for i, piece in enumerate(model.pieces):
        if piece.type in (1, 4):
            ids[piece.piece], scores[piece.piece], texts[i] = i, piece.score, piece.piece
        elif piece.type == 6:
            byte_ids[int(piece.piece[3:5], 16)] = i
        elif piece.type == 2:
            unknown = i
    return Pieces(ids, scores, byte_ids if model.trainer_spec.byte_fallback else [], texts, unknown, model.trainer_spec.model_type == 2, rule.add_dummy_prefix)


def _lists(found: list[bytes | None]) -> pa.Array:
    """An Arrow array of lists of 32-bit numbers, null where there are none."""
    ends = np.cumsum([0, *(0 if x is None else len(x) // 4 for x in found)])
    values = pa.array(np.frombuffer(b"".join(x for x in found if x), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([x is None for x in found], pa.bool_()))


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with an array of piece ids."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    name, body = fresh(docs, name, "body")
    schema = docs.withColumn(name, F.lit(None).cast("array<int>")).schema
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, bytes] = {}
        for batch in slices(batches, body, BATCH):
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], _lists(sent.value.encode_batch(batch.column(body).to_pylist(), cache))], names=schema.names)

    return docs.withColumn(body, F.col(text)).mapInArrow(run, schema)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the text of an array of piece ids; numbers that are no piece's say nothing."""
    sent = rows.sparkSession.sparkContext.broadcast(pieces)
    name, given = fresh(rows, name, "given")
    schema = rows.withColumn(name, F.lit(None).cast("string")).schema
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = (x.values if x.is_valid else None for x in part.column(width))
                found = [None if x is None else sent.value.decode(x.drop_null().to_numpy(zero_copy_only=False)) for x in lists]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(width)], pa.array(found, pa.string())], names=schema.names)

    return rows.withColumn(given, F.col(ids)).mapInArrow(run, schema)
