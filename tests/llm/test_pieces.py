"""Pieces against the model's own library, Viterbi against all segmentations, exact round trips, defined cases."""

import random

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import pieces


def test_as_the_library(spark, sf):
    model, library = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDE     \n\t.,;0123456789éñü日本語한국😀--==//__  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert model.encode(texts, {}) == library.encode(texts)
    assert [model.decode(x) for x in model.encode(texts, {})] == texts


def test_unigram_forward_scores_as_all_segmentations():
    rng = random.Random(2)
    scores = {p: rng.uniform(-9, -1) for p in ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "cab", "▁ab"]}
    model = pieces.Pieces({p: i for i, p in enumerate(scores)}, scores, [], dict(enumerate(scores)), 99, False, True)

    def best(word):
        return max([(scores[word[:n]] + best(word[n:])[0], [word[:n], *best(word[n:])[1]]) for n in range(1, 4) if word[:n] in scores], default=(float("-inf") if word else 0.0, [])) if word else (0.0, [])

    words = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(300)]
    got = model.forward(words)
    for word in words:
        assert [model.texts[i] for i in np.frombuffer(got[word], np.int32)] == best(word)[1]


def test_merges_are_the_one_segmentation_of_greatest_score():
    """Of all segmentations of short words, those without a pair that would merge otherwise: one, and the library's."""
    model, library = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)

    def every(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            if word[:n] in model.whole:
                yield from ([word[:n], *rest] for rest in every(word[n:]))

    for word in ("the", "tionings", "abcabc", "undernt", "xqzt", "eaning"):
        marked = pieces.MARK + word
        best = [x for x in every(marked) if all(model.stays(a, b) for a, b in zip(x, x[1:]))]
        assert best == [library.encode(word, out_type=str)]


def test_defined_cases(spark):
    long = "ab" * 40_000 + " " * 3000 + "é\n"
    rows = [(1, None, 1), (2, "", 1), (3, " a  b ", 1), (3, " a  b ", 1), (None, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body int").withColumn("given", F.lit("clash"))
    model = pieces.load()
    back = pieces.decode(pieces.encode(docs, model), model)
    assert back.columns == [*docs.columns, "ids", "decoded"]
    clash = pieces.decode(pieces.encode(docs.withColumn("IDS", F.lit(1)).withColumn("decoded", F.lit(2)), model), model, "ids_")
    assert clash.columns == [*docs.columns, "IDS", "decoded", "ids_", "decoded_"] and clash.where("text is not null and text <> decoded_").count() == 0
    got = back.collect()
    assert len(got) == 5 and all(r.text == r.decoded for r in got)
    assert {str(r.doc_id): r.ids for r in got}["1"] is None and {str(r.doc_id): r.ids for r in got}["2"] == []
    assert pieces.decode(pieces.encode(docs.limit(0), model), model).count() == 0
