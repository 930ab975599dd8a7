"""Language identification: held-out accuracy, the backoff by hand, defined cases."""

import math
import unicodedata
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import langid, registry
from quern.llm.common import crc_mod


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = crc_mod("doc_id", 4)
    model = langid.fit(docs, train=fold != 2)
    found = langid.identify(docs.where(fold == 2), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert found[0] > 0.98 and 0 <= found[1] <= found[2] <= 1


def plain_words(text):
    """Runs of letters and marks that begin with a letter."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_model(rows):
    counts = {}  # (language, kind) to the counts of names
    for text, lang in rows:
        for w in plain_words(text):
            counts.setdefault((lang, 0), Counter())[w] += 1
            for n in range(1, 6):
                marked = f"^{w}$" if n > 1 else w
                for i in range(len(marked) - n + 1):
                    counts.setdefault((lang, n), Counter())[marked[i : i + n]] += 1
    return counts


def plain_prediction(counts, text):
    langs, seen = sorted({k for k, _ in counts}), Counter(plain_words(text))
    if not seen:
        return "und", 0.0
    names = {n: {x for (_, k), c in counts.items() if k == n for x in c} for n in range(6)}
    size = {n: len(names[0]) if not n else sum(len(names[k]) for k in range(1, 6)) for n in range(6)}
    score = lambda lang, n, x: math.log((counts.get((lang, n), {}).get(x, 0) + 0.5) / (sum(counts.get((lang, n), {}).values()) + 0.5 * size[n]))
    sums = {lang: 0.0 for lang in langs}
    for w, times in seen.items():
        kind, parts = (0, [w]) if w in names[0] else (0, [])
        for n in range(5, 0, -1) if not parts else ():
            marked = f"^{w}$" if n > 1 else w
            parts, kind = [g for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in names[n]], n
            if parts:
                break
        for lang in langs if parts else ():
            sums[lang] += times * sum(score(lang, kind, x) for x in parts) / len(parts)
    heat = min(1, 12 / sum(seen.values()))
    best = max(langs, key=lambda x: (round(sums[x], 9), -langs.index(x)))
    return best, math.exp(0) / sum(math.exp((v - sums[best]) * heat) for v in sums.values())


def test_as_plain_reimplementation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    odd = ["\u00bd \u00b2 \u2460", "\u2167 12", "\u0939\u093f\u0928\u094d\u0926\u0940 bhasha", "e\u0301cole la", "zz zzz", "\u4e2d\u6587", "the\u0301", "\u0301"]
    counts = plain_model([r for r in rows if r[0] is not None and r[1] is not None])
    model = langid.fit(docs, rows=10**9, most_bytes=10**12)
    for text in [t for t, _ in rows] + odd:
        (a, x), (b, y) = model.predict(text), plain_prediction(counts, text)
        assert a == b and abs(x - y) < 1e-6, text
    assert model.predict("\u00bd \u00b2 \u2460") == ("und", 0.0) and langid.tokens(odd[2])[0] == odd[2].split()[0]


def test_registered_query_as_plain_reimplementation(spark, sf):
    """On sf0.001 the sample is all labelled rows."""
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    counts = plain_model([(r.text, r.lang) for r in rows if not held[r.doc_id] and r.text is not None and r.lang is not None])
    got = {r.doc_id: r for r in registry.op7_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = plain_prediction(counts, r.text)
        assert (got[r.doc_id].held_out, got[r.doc_id].lang_pred) == (held[r.doc_id], want[0]) and abs(got[r.doc_id].score - want[1]) < 1e-6


def test_backoff_order_and_many_languages(spark):
    rows = [(1, "abc abc abd", "x"), (2, "zzz abq", "y"), (3, None, "x"), (4, "abc", None)] + [(10 + i, f"k{chr(97 + i % 26)}{'q' * (i // 26)}", f"l{i:03}") for i in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 302 and {"abc", "abd", "zzz", "abq"} <= set(model.words)
    assert model.unseen("abcd") == (4, [model.grams["^abc"]]) and model.unseen("\u00f6\u00f6") == (0, [])
    assert model.predict("ABC abd")[0] == "x" and model.predict("zzz")[0] == "y" and model.predict("kbqqq")[0] == "l079"


def test_defined_cases(spark):
    long = "the house " * 50_000
    rows = [(1, None, "en", 1), (2, "", None, 1), (3, "12 34 !!", "en", 1), (4, long, "en", 1), (5, "maison la", "fr", 1), (5, "maison la", "fr", 1), (None, "ö", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    model = langid.fit(docs)
    got = sorted((str(r.doc_id), r.p) for r in langid.identify(docs, model, prediction="p").collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("5", "fr"), ("5", "fr"), ("None", "en")]
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "None"]
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs.drop("lang_pred"), nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.identify(docs.withColumn("Score", F.lit(1)), model).columns[-2:] == ["lang_pred_", "score_"]
    assert {r.lang_pred_ for r in langid.identify(docs, model).collect()} == {"und", "en", "fr"}
