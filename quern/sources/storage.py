"""Stored tables: cut lineage in the shared folder, positions of rows, files that are written whole."""

from __future__ import annotations

import re
import uuid

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POS = "__pos"
#: Bits of a scan position that number the rows of a file; the bits above number the files.
ROW_BITS = 40
#: Files up to which a scan's file numbers are a literal map, and bytes of paths up to which a table of them is broadcast.
FEW_FILES, MOST_PATHS = 32, 64 << 20


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one below the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quern_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, so a lost executor costs no recomputation.

    The files go when the session ends.
    """
    path = f"{shared_dir(df.sparkSession)}/quern-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, fs = _fs(df.sparkSession, path)
    fs.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a table that stored() gave, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def numbered(df: DataFrame, order: str | None = None, start: int = 0, name: str = POS) -> DataFrame:
    """df with dense numbers from `start`, in the order of a column or else of the rows as they come.

    Rows are written once with the partition and the number in it that Spark gives them; the counts of the
    partitions, a row for each, give the offsets.  So no task sees more than its own rows.
    """
    if order is not None:
        df = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    raw = stored(df.withColumn("__mid", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__mid", 33)
    counts = raw.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start)
    joined = raw.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row for each partition
    return joined.withColumn(name, place.cast("long")).select(*df.columns, name)


def is_scan(df: DataFrame) -> bool:
    """Whether df is columns and rows of Parquet files as they stand, so that a row is known by its file and number."""

    def plain(plan) -> bool:
        name, children = plan.nodeName(), plan.children()
        if name == "LogicalRelation":
            return plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and "parquet" in plan.relation().fileFormat().toString().lower()
        return name in ("Project", "Filter", "SubqueryAlias") and plan.deterministic() and children.size() == 1 and plain(children.apply(0))

    return plain(df._jdf.queryExecution().analyzed())


def scan_positions(df: DataFrame, name: str = POS) -> DataFrame:
    """A plain scan with a number for each row: that of its file, in the order of paths, and its own in the file.

    It does not depend on how the files are split, and filters still reach the scan below it.
    """
    files = sorted(re.sub("^([^:/]+):/+", r"\1:/", unquote(f)) for f in df.inputFiles())
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    row, shown = F.col("_metadata.row_index"), F.regexp_replace(decoded, "^([^:/]+):/+", "$1:/")
    lost = F.raise_error(F.lit("a file came after the scan was planned")).cast("long")
    if len(files) <= 1:
        return df.withColumn(name, row)
    if len(files) <= FEW_FILES:
        number = F.element_at(F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f), F.lit(i))]), shown)
        return df.withColumn(name, F.shiftleft(F.coalesce(number.cast("long"), lost), ROW_BITS) + row)
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), "__file long, __path string")
    if sum(map(len, files)) <= MOST_PATHS:
        numbers = F.broadcast(numbers)
    joined = df.withColumn("__row", row).withColumn("__shown", shown).join(numbers, F.col("__shown") == F.col("__path"), "left")
    return joined.withColumn(name, F.shiftleft(F.coalesce("__file", lost), ROW_BITS) + F.col("__row")).select(*df.columns, name)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A new text file: written beside its place and renamed, so it is there whole or not at all."""
    where, fs = _fs(spark, path)
    new, _ = _fs(spark, path + ".tmp")
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(new, where):
        raise OSError(f"cannot rename {path}.tmp")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


def listing(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none where there is no folder."""
    where, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)
