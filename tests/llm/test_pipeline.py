"""The pipeline against brute force, stage by stage, and its defined cases."""

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import langid, pieces
from tests.llm.test_credentials import BASE, WEAK, plain
from tests.llm.test_positions import brute
from tests.llm.test_near_copies import slow_roots


def hidden(text):
    """The text with the spans of the plain scan replaced, overlapping ones as one."""
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in plain(text)[1].split(",") if s)
    merged = []
    for a, b in spans:
        if merged and merged[-1][1] > a:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:a] + "[REDACTED]" + text[b:]
    return text


def expected(rows, items, model):
    """rows: (doc_id, text); what each stage keeps, in plain Python."""
    kept = [(i, t) for i, t in rows if (p := model.predict(t))[0] != "und" and p[1] >= 0.35]
    yield kept
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0]))
    roots = slow_roots([t for _, t in kept])
    kept = [r for n, r in enumerate(kept) if roots[n] == n]
    yield kept
    kept = [r for r, found in zip(kept, brute(kept, items)) if not found[3]]
    yield kept
    kept = [(i, hidden(t)) for i, t in kept]
    yield kept
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    yield [(i, tuple(library.encode(t))) for i, t in kept]


def test_stages_as_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(90001, "token = abcdef123 the and that this of in to with", "en", "x", 49), (90002, "12 34", "en", "x", 5), (90003, None, None, None, None)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows, items, langid.fit(docs))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    for number, ((_, stage), kept) in enumerate(zip(corpus_pipeline.STAGES, want)):
        out = stage(spark, docs, sf)
        if number < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        got = docs.collect()
        assert sorted((r.doc_id, tuple(r.ids) if number == 4 else r.text) for r in got) == sorted(kept)
        assert number < 4 or all(r.restored for r in got)
    assert BASE and WEAK


def test_run_and_empty_tables(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).where("not restored").count() == 0
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
