"""A run that can be stopped and resumed: rows stream through the mechanism once, whatever happens in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textveil.config import TokenConfig
from textveil.operators.privatize import privatize


def privatize_stream(spark: SparkSession, source: str, target: str, checkpoint: str, config: TokenConfig, max_files: int = 100):
    """Privatise Parquet files (row_idx, Text) as they arrive in source, into target; all that is there now is done on return.

    Structured Streaming's checkpoint says which files are done, and the Parquet sink commits a batch as a whole, so a
    run that was stopped goes on where it was and no row is lost or written twice. Draws depend on the seed, the row
    and the place, so a batch that is tried again gives the same text.
    """
    rows = spark.readStream.schema("row_idx long, Text string").option("maxFilesPerTrigger", max_files).parquet(source)
    query = privatize(rows, config).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def completed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).select("row_idx")
