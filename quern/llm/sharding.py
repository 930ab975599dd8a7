"""Sharding by sampled splitters, in DataFrame functions only.

Rows are ordered by a key.  A sample in which a row's chance follows its size gives the splitters of many small
ranges; each range is measured, and an overfull one is cut again by a sample of its own.  A range is a window
partition: running sums within it, put on top of the sums of the ranges before it, give every row its exact
place, and a shard takes an equal share of the bytes.  So each shard is an interval of the key order whose size
differs from the mean by less than one row's size, whatever the sample.

The key order is (key, CRC-32 and size of the text, row number as stored): rows that repeat a key, or a whole row, are
still told apart, so no range is bound to one key, and what a row gets follows from the rows alone.  Only the sample, a row for each range and a row for each shard are
gathered, all of them bounded by the parameters.

Defined cases: a null text has the size of the overhead alone, a null key sorts first, repeated rows are rows of
their own and those that are equal change places freely, a very long text is one row, other columns are not looked at
and may have any name, an empty table gives an empty result.
"""

from __future__ import annotations

import json
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, StringType

from quern.llm.common import forget, stored

#: Most ranges, and so the bound of what is gathered: SAMPLES keys for each range.
MOST_RANGES, SAMPLES = 16_384, 48


def _literal(rows: list, dtype) -> Column:
    """An array of keys, or of arrays of keys, as a constant; one JSON text for plain types, which is folded once."""
    nested = bool(rows) and isinstance(rows[0], list)
    kind = ArrayType(ArrayType(dtype)) if nested else ArrayType(dtype)
    if all(isinstance(f.dataType, IntegralType | StringType) for f in dtype.fields):
        names = dtype.names
        plain = lambda row: dict(zip(names, row))
        text = json.dumps([[plain(r) for r in block] for block in rows] if nested else [plain(r) for r in rows])
        return F.from_json(F.lit(text), kind)
    if nested:
        return F.array(*[_literal(block, dtype) for block in rows]).cast(kind)
    fields = [(f.name, f.dataType) for f in dtype.fields]
    return F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, (n, k) in zip(row, fields)]) for row in rows]).cast(kind)


def _range_of(key: Column, splitters: list, dtype) -> Column:
    """How many of the sorted splitters are not above the key; two steps of about the root of their number."""
    if not splitters:
        return F.lit(0)
    step = isqrt(len(splitters)) + 1
    coarse = _literal(splitters[::step], dtype)
    blocks = _literal([splitters[i + 1 : i + step] for i in range(0, len(splitters), step)], dtype)
    above = F.size(F.filter(coarse, lambda s: s <= key))
    within = F.size(F.filter(F.get(blocks, above - 1), lambda s: s <= key))
    return F.when(above == 0, F.lit(0)).otherwise((above - 1) * step + 1 + within)


def _quantiles(sample: list, pieces: int) -> list:
    """The keys that cut (key, weight) rows, sorted by key, into pieces of about equal weight."""
    total, run, found = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        run += weight
        if len(found) < pieces - 1 and run >= total * (len(found) + 1) / pieces:
            found.append(key)
    return found


def splitters_of(slim: DataFrame, total: int, ranges: int, samples: int, rounds: int = 6) -> tuple[list, DataFrame]:
    """Sorted splitters of `slim` (k, size), and the measured ranges (r, bytes, n) that they make.

    A range over twice its share is sampled anew and subdivided, up to `rounds` times.
    """
    dtype = slim.schema["k"].dataType
    unit = lambda number: F.pmod(F.xxhash64("k", F.lit(f"sample {number}")), F.lit(1 << 30)) / float(1 << 30)

    def drawn(rows: DataFrame, rate: Column) -> list:
        """Keys by size: a row is drawn with the chance rate * size, and counts for what it stands for."""
        chance = F.col("size") * rate
        got = rows.where(unit(0) < chance).select("k", F.greatest(F.col("size").cast("double"), 1 / rate).alias("w"))
        return [(r.k, r.w) for r in got.sort("k").collect()]

    found = _quantiles(drawn(slim, F.lit(samples * ranges / total)), ranges)
    share = 2 * ceil(total / ranges)
    for number in range(1, rounds + 2):
        marked = slim.withColumn("r", _range_of(F.col("k"), found, dtype))
        measured = marked.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        over = [] if number > rounds else measured.where((F.col("bytes") > share) & (F.col("n") > 1)).limit(2 * ranges).collect()
        if not over:
            return found, measured
        rate = F.lit(0.0)
        for row in over:
            rate = F.when(F.col("r") == row.r, F.lit(samples * ceil(row.bytes / share) * 2 / row.bytes)).otherwise(rate)
        rows = marked.where(F.col("r").isin([row.r for row in over]))
        again: dict[int, list] = {}
        chance = F.col("size") * rate
        got = rows.where(unit(number) < chance).select("k", "r", F.greatest(F.col("size").cast("double"), 1 / rate).alias("w")).sort("k").collect()
        for row in got:
            again.setdefault(row.r, []).append((row.k, row.w))
        pieces = {row.r: 2 * ceil(row.bytes / share) for row in over}
        new = [k for r, sample in again.items() for k in _quantiles(sample, pieces[r])]
        order = lambda k: tuple((v is not None, v) for v in k)
        found = sorted({tuple(k): k for k in [*found, *new]}.values(), key=order)
    return found, measured


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16, rows_per_range: int = 1_000_000, samples: int = SAMPLES) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; shards are equal shares of the bytes in key order.

    slot numbers a shard's rows from 0 without gaps, in key order.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = (F.octet_length(body) + overhead).cast("long")
    slim = stored(
        docs.select(
            F.struct(F.col(key).alias("key"), F.crc32(body).alias("h"), size.alias("size"), F.monotonically_increasing_id().alias("tie")).alias("k"),
            size.alias("size"),
            F.crc32(body).alias("text_crc32"),
        ),
        "sizes",
    )
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST_RANGES, max(4 * shards, ceil(rows / rows_per_range)))
    splitters, measured = splitters_of(slim, max(total, 1), ranges, samples)
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = measured.select("r", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    upto = Window.partitionBy("r").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        slim.withColumn("r", _range_of(F.col("k"), splitters, slim.schema["k"].dataType))
        .withColumn("upto", F.sum("size").over(upto))
        .withColumn("number", F.row_number().over(Window.partitionBy("r").orderBy("k")))
        .join(F.broadcast(offsets), "r")
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(2.0 * max(total, 1)))).cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("number") - 1)
        .select(F.col("k.key").alias(key), "size", "text_crc32", "shard", "row")
    )
    placed = stored(placed, "placed")
    forget(slim)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(key, "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def oracle(shards: int = 40, overhead: int = 16) -> str:
    """DuckDB SQL of the query: running sums over all rows at once, and CRC-32 by its table."""
    return f"""
WITH RECURSIVE t(i, k, v) AS (SELECT CAST(unnest(range(256)) AS BIGINT), 0, CAST(unnest(range(256)) AS BIGINT)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS v FROM t WHERE k = 8),
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + {overhead} AS BIGINT) AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, b: xor(a >> 8, tab.v[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
r AS (SELECT *, 2 * sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS middle, sum(size) OVER () AS total, row_number() OVER w AS place FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)),
s AS (SELECT *, CAST(least({shards - 1}, floor(middle * {shards} / (2.0::DOUBLE * total))) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
