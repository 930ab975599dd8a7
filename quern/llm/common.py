"""What the operators of this subpackage share: stored tables, batches of bounded size, names that clash with nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.storage import forget, is_scan, scan_positions, shared_dir, stored  # noqa: F401  (what the operators take from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_join(rows: DataFrame, unique: DataFrame, key: str, how: str = "inner", hot: int = 64) -> DataFrame:
    """rows joined with a table that has each key once; rows of frequent keys are dealt to several tasks.

    A key is frequent beyond a thousandth of the rows (and `hot`), so there are at most a thousand of them: these, and
    nothing else, are broadcast.  A frequent key's rows are split by a hash of the whole row, its partner is repeated
    for each part.
    """
    total = rows.count()
    most = max(hot, total // 1000)
    if total <= most:
        return rows.join(unique, key, how)
    part, parts = fresh(rows, "join_part", "join_parts")
    heavy = F.broadcast(rows.groupBy(key).agg(F.count("*").alias(parts)).where(F.col(parts) > most).select(key, F.ceil(F.col(parts) / most).cast("int").alias(parts)))
    many = F.coalesce(F.col(parts), F.lit(1))
    left = rows.join(heavy, key, "left").withColumn(part, F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), many).cast("int")).drop(parts)
    right = unique.join(heavy, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), many - 1))).drop(parts)
    return left.join(right, [key, part], how).drop(part)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys (whole numbers, not null) of batches sorted by them; only the last run is held."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        new = new if held is None else pa.concat_tables([held, new])
        if not new.num_rows:
            continue
        values = np.stack([new.column(k).to_numpy().astype(np.int64) for k in keys])
        cuts = np.r_[0, np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1].tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield new.slice(a, b - a)
        held = new.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def with_uid(df: DataFrame, name: str) -> DataFrame:
    """df with a number that tells rows apart and stays: by file and row where df is a plain scan; anything else is stored first."""
    return scan_positions(df, name) if is_scan(df) else stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each have about `most` bytes; a longer text is alone."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pc.binary_length(batch.column(text)).to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def crc_mod(key: str, modulus: int):
    """The remainder of the CRC-32 of a key as text; null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")
