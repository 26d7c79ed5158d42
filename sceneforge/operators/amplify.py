"""Amplifying a seed table to a larger one of the same shape."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sceneforge.functions import column, hash_unit, is_numeric, is_text

# Size aimed at, size of the noise, and distinct values below
# which a column is a code rather than a measure.
TARGET_BYTES = 1 << 30
NOISE = 0.01
CODE_VALUES = 10

# Copies made next to each other, and output rows per task, when there are many copies.
COPIES_PER_RANGE = 64
ROWS_PER_TASK = 2_000_000

_ID_NAME = re.compile(r"(^|_)id$", re.IGNORECASE)
_LABEL_NAME = re.compile(r"label", re.IGNORECASE)

# A column estimated above this is surely not a code and needs no exact count.
_SURELY_MANY = 10 * CODE_VALUES


def replicas_for(seed_bytes: int, target_bytes: int = TARGET_BYTES) -> int:
    """Copies of the seed that reach the target size."""
    return target_bytes // seed_bytes + 1


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a stored table, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def id_columns(df: DataFrame, listed: Sequence[str] = ()) -> list[str]:
    """Columns named ``id`` or ``..._id``, and the ones listed."""
    return [c for c in df.columns if c in listed or _ID_NAME.search(c)]


def code_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those columns with fewer than ten distinct values.

    One estimating pass sorts out the columns with many; only the rest are
    counted exactly, which is cheap because they have few values.
    """
    if not names:
        return []
    guess = df.agg(*[F.approx_count_distinct(column(c)).alias(c) for c in names]).first().asDict()
    few = [c for c in names if guess[c] <= _SURELY_MANY]
    if not few:
        return []
    exact = df.agg(*[F.count_distinct(column(c)).alias(c) for c in few]).first().asDict()
    return [c for c in few if exact[c] < CODE_VALUES]


def jitter_columns(df: DataFrame, ids: Sequence[str]) -> list[str]:
    """Numeric measures: no ids, no labels, no codes."""
    numbers = [
        f.name for f in df.schema.fields
        if is_numeric(f) and f.name not in ids and not _LABEL_NAME.search(f.name)
    ]
    codes = set(code_columns(df, numbers))
    return [c for c in numbers if c not in codes]


def replicate(df: DataFrame, copies: int, name: str = "replica", rows: int | None = None) -> DataFrame:
    """Every row ``copies`` times with its replica number from 0, without a join.

    A few copies are made where the rows lie.  Many copies of a small seed
    would leave all the work to the few tasks that read it, so ranges of
    replica numbers are spread over the cluster first; only one row per range
    is shuffled, a small part of the output.
    """
    if copies <= COPIES_PER_RANGE:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    ranges = -(-copies // COPIES_PER_RANGE)
    total = (df.count() if rows is None else rows) * copies
    first = F.col("_range") * COPIES_PER_RANGE
    last = F.least(first + (COPIES_PER_RANGE - 1), F.lit(copies - 1))
    spread = df.withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    return (
        spread.repartition(max(1, -(-total // ROWS_PER_TASK)))
        .withColumn(name, F.explode(F.sequence(first, last)))
        .drop("_range")
    )


def jitter(value: Column, noise: Column, size: float = NOISE) -> Column:
    """The value times 1 + U(-size, size) for a noise in [0, 1)."""
    return value.cast("double") * (F.lit(1.0) + (noise * (2 * size) - size))


def amplify(
    df: DataFrame,
    copies: int,
    key: Sequence[str],
    ids: Sequence[str] = (),
    seed: int | None = None,
    keep_replica: bool = False,
) -> DataFrame:
    """Copies of the table with jittered measures and shifted ids.

    Noise comes from the row key, the replica and the column name, so every
    retry writes the same rows; with a ``seed`` it comes from ``rand`` instead.
    Numeric ids move by the row count per replica, text ids get a suffix.
    """
    id_names = id_columns(df, ids)
    measured = jitter_columns(df, id_names)
    rows = df.count()
    many = replicate(df, copies, rows=rows)

    def changed(field: T.StructField, place: int) -> Column:
        value = column(field.name)
        if field.name in id_names:
            if is_numeric(field):
                moved = value + F.lit(rows) * (F.col("replica") + 1)
                whole = isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
                return moved.cast("long" if whole else field.dataType)  # whole ids get room for all copies
            if is_text(field):
                return F.concat(value, F.lit("_"), F.col("replica").cast("string"))
            return value
        if field.name in measured:
            noise = (
                F.rand(seed + place)
                if seed is not None
                else hash_unit(*key, F.col("replica").cast("string"), F.lit(field.name))
            )
            return jitter(value, noise)
        return value

    out = [changed(f, i).alias(f.name) for i, f in enumerate(df.schema.fields)]
    return many.select(*out, *(["replica"] if keep_replica else []))
