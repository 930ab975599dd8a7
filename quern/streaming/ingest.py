"""Incremental loading: files that arrive in a folder are appended to a stored table, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def appended(spark: SparkSession, folder: str, schema: StructType, table: str, checkpoint: str, files_per_batch: int = 64) -> DataFrame:
    """Take in the CSV files of a folder that are not in the table yet, and give the table.

    The checkpoint records which files are in; a run that broke off is taken up where it was.
    """
    options = {"header": True, "mode": "FAILFAST", "ignoreLeadingWhiteSpace": True, "enforceSchema": True, "maxFilesPerTrigger": files_per_batch}
    stream = spark.readStream.schema(schema).options(**options).csv(folder)
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(table)
