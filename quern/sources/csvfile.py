"""CSV files whose header names fully qualified columns, and other delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, IntegerType, StructField, StructType


def header(spark: SparkSession, path: str) -> list[str]:
    """The cells of the first line."""
    rows = spark.read.text(path).limit(1).collect()
    return [cell.strip().strip('"') for cell in rows[0].value.split(",")] if rows else []


def read(spark: SparkSession, path: str, names: list[str], kinds: list[DataType] | None = None) -> DataFrame:
    """The body as columns of known types; a value that does not fit, or a short row, fails when it is read."""
    schema = StructType([StructField(n, k, True) for n, k in zip(names, kinds or [IntegerType()] * len(names))])
    options = {"header": True, "mode": "FAILFAST", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "enforceSchema": True}
    return spark.read.schema(schema).options(**options).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", comment: str | None = None, header_line: bool = True) -> DataFrame:
    """Delimited text with a header, or with comment lines instead of one; NA is null."""
    options = {"sep": sep, "header": header_line, "nullValue": "NA", "ignoreLeadingWhiteSpace": True}
    if comment:
        options["comment"] = comment
    return spark.read.schema(schema).options(**options).csv(path)
