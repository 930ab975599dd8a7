"""Components of SimHash near-duplicates where keys repeat."""

from quern.llm import simhash


def test_a_key_that_is_smallest_in_two_components_keeps_both(spark):
    rows = [(7, "a b c d e f"), (7, "p q r s t u"), (8, "a b c d e f"), (9, "p q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == rows[:2]
