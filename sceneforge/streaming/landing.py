"""Scoring files as they land in a folder (L1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def watch(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    glob: str | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Stream of the rows of files that land in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(folder)


def score_landing(
    landed: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    once: bool = True,
    every: str = "10 seconds",
) -> StreamingQuery:
    """Score each landed file exactly once and append the rows to a Parquet table.

    Scoring keeps no state between rows, so the same function serves batch
    tables.  The checkpoint belongs in shared storage; a restarted query goes on
    where it stopped.
    """
    writer = (
        landed.transform(score)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    timed = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return timed.start()
