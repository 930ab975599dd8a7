"""License scans against SQL over all pairs, and defined cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import licenses, registry


def key(row):
    return tuple(str(x) for x in row)


def test_as_sql(spark, sf):
    got = registry.op3_license_scan(spark, sf).collect()
    want = duckdb.sql(licenses.oracle(f"'{sf}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and any(r.n_matches for r in got)


def test_pruning_loses_nothing():
    known = licenses.Templates(licenses.TEMPLATES, 0.8)
    for _, name, theirs in known.all:
        words = [a for a, _ in sorted(theirs)]
        assert not list(known.of(words[:1]))
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            ws = licenses.words(text)
            for unit in (ws, ws[1:], ws + [b"x"], ws[::2], ws * 2):
                own = licenses.bigrams(unit)
                want = {(n, len(own & b)) for size, n, b in known.all if own and 2 * len(own & b) / (len(own) + size) >= 0.8}
                assert {(n, s) for n, s, _ in known.of(unit)} == want


def test_defined_cases(spark):
    mit = "Released under the MIT License."
    split = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met"
    rows = [(1, None), (2, ""), (3, "word"), (4, mit), (4, mit), (5, f"a b\n{mit}\n\nc\n{mit.upper()}"), (None, split), (7, "x y " * 50_000 + f"\n{mit}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("body", F.lit(1)).withColumn("n_units", F.lit("clash"))
    found = licenses.scan(docs)
    assert found.columns == [*docs.columns, "n_units_", "n_matches", "n_windows", "licenses", "best_dice"]
    got = sorted(((str(r.doc_id), r.n_units_, r.n_matches, ",".join(r.licenses), r.best_dice) for r in found.collect()), key=str)
    assert [g[:4] for g in got] == [("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 1, 0, ""), ("4", 1, 1, "MIT"), ("4", 1, 1, "MIT"), ("5", 6, 4, "MIT"), ("7", 3, 1, "MIT"), ("None", 4, 1, "BSD-2-Clause")]
    assert got[3][4] == pytest.approx(1.0)
    assert licenses.scan(docs.limit(0)).count() == 0
