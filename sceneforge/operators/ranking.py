"""Numbering a whole table in order without passing it through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneforge.session import write_out

# Rows one task may number.
ROWS_PER_TASK = 500_000


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    name: str = "row_number",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the 1-based position of each row under a total order.

    The rows are written out in ranges; each range is numbered on its own and
    shifted by the row count of the ranges before it.  The table of range sizes
    has one row per range, so it is the only broadcast side.
    """
    tasks = max(1, -(-df.count() // rows_per_task))
    part, within, size, shift = "_range", "_within", "_size", "_shift"
    if tasks == 1:
        alone = df.withColumn(part, F.lit(0))
        position = F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long")
        return alone.withColumn(name, position).drop(part)
    parted = write_out(
        df.repartitionByRange(tasks, *order).withColumn(part, F.spark_partition_id()), "ranges"
    )
    numbered = parted.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    sizes = parted.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(shift))
    return (
        numbered.join(F.broadcast(shifts), part)
        .withColumn(name, F.col(within) + F.col(shift))
        .drop(part, within, shift)
    )


def frequency_index(df: DataFrame, name: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``value, cnt, idx``: categories numbered from 0 by falling count, ties by value.

    The same numbers a string indexer gives, but the categories stay
    distributed.  The counts are written out once, since they are read twice.
    """
    counts = write_out(
        df.filter(F.col(name).isNotNull())
        .groupBy(F.col(name).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt")),
        "counts",
    )
    ranked = number_rows(counts, [F.desc("cnt"), F.asc("value")], "idx", rows_per_task)
    return ranked.select("value", "cnt", (F.col("idx") - 1).alias("idx"))
