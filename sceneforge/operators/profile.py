"""Column profile of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from sceneforge.functions import is_numeric, quoted, text

# Columns side by side in one row of cells.  Spark compiles an aggregation into one
# loop up to a hundred buffers, eight per column here; beyond that it runs several
# times slower.  The cells of a wider table are folded into several rows, numbered
# by part, inside the task that reads them: one scan and one aggregation in all.
CELLS_PER_ROW = 12

# Percentage of missing values above which a column is warned of, and the warning.
MISSING_THRESHOLD = 50.0
WARNING = 'Column "%s" has %.1f%% missing values (threshold: %.0f%%)'

_STATS = {"min": "min", "max": "max", "mean": "avg", "std": "stddev_samp"}


# The expressions are SQL text, which Spark takes in one call for all columns; a
# table of several hundred columns would otherwise spend its time on calls.


def _cell(field: T.StructField) -> str:
    """The value as a number, 0 for what is no number, null for what is missing."""
    value = quoted(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        # NaN would win every max and poison every mean; it counts as missing.
        value = f"nanvl({value}, NULL)"
    return f"CAST({value} AS DOUBLE)" if is_numeric(field) else f"IF({value} IS NULL, NULL, 0D)"


def _cells(df: DataFrame, fields: Sequence[T.StructField], width: int) -> DataFrame:
    """(part, v0, v1, ...): ``width`` cells a row, the rows of a part holding the same columns."""
    parts = [list(map(_cell, fields[i : i + width])) for i in range(0, len(fields), width)]
    parts[-1] += ["CAST(NULL AS DOUBLE)"] * (width - len(parts[-1]))
    rows = [[f"{i} AS part", *[f"{c} AS v{k}" for k, c in enumerate(cells)]] for i, cells in enumerate(parts)]
    if len(rows) == 1:
        return df.selectExpr(*rows[0])
    return df.selectExpr(f"inline(array({', '.join('struct(' + ', '.join(row) + ')' for row in rows)}))")


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2, cells_per_row: int = CELLS_PER_ROW
) -> DataFrame:
    """One row per column: nulls (NaN included), their share, and min/max/mean/std of numbers.

    The table is read once, however wide it is; what is shuffled is a row per task
    and ``cells_per_row`` columns.
    """
    wanted = set(df.columns if columns is None else columns)
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if f.name in wanted]
    if not fields:
        raise ValueError("no column to profile")
    width = min(cells_per_row, len(fields))
    cells = _cells(df, [f for _, f in fields], width)
    stats = [f"{fn}(v{k}) AS {kind}{k}" for k in range(width) for kind, fn in {"n": "count", **_STATS}.items()]
    known = [
        f"'name', {text(f.name)}, 'ordinal', {i}, 'type', {text(f.dataType.simpleString())}, 'is_number', {is_numeric(f)}"
        for i, f in fields
    ]
    measured = [f"'n', n{k}, " + ", ".join(f"'{kind}', {kind}{k}" for kind in _STATS) for k in range(width)]
    if len(fields) == width:
        entries = ", ".join(f"named_struct({f}, {m})" for f, m in zip(known, measured))
        told = cells.selectExpr("count(1) AS counted", *stats).selectExpr("counted", f"inline(array({entries}))")
    else:  # the columns are known apart from their cells, as an empty table has none
        grouped = cells.groupBy("part").agg(F.expr("count(1) AS counted"), *map(F.expr, stats))
        entries = ", ".join(f"named_struct('slot', part * {width} + {k}, {m})" for k, m in enumerate(measured))
        grouped = grouped.selectExpr("counted", f"inline(array({entries}))")
        entries = ", ".join(f"named_struct('slot', {slot}, {f})" for slot, f in enumerate(known))
        told = df.sparkSession.range(1).selectExpr(f"inline(array({entries}))")
        told = told.join(F.broadcast(grouped), "slot", "left")  # a row per column of the table on either side
    return told.selectExpr(
        "name", "ordinal", "type", "coalesce(counted, 0L) AS total_rows",
        "coalesce(counted - n, 0L) AS null_count", "round(try_divide((counted - n) * 100D, counted), 1) AS null_pct",
        *[f"IF(is_number, round(`{kind}`, {digits}), NULL) AS `{kind}`" for kind in _STATS],
    )


def add_warnings(profile: DataFrame, threshold: float = MISSING_THRESHOLD) -> DataFrame:
    """Add a message where a column's share of missing values is above the threshold."""
    message = F.format_string(WARNING, F.col("name"), F.col("null_pct"), F.lit(float(threshold)))
    return profile.withColumn("warning", F.when(F.col("null_pct") > threshold, message))


def missing_warnings(profile: DataFrame, threshold: float = MISSING_THRESHOLD) -> DataFrame:
    """The columns with a warning."""
    warned = add_warnings(profile, threshold).filter(F.col("warning").isNotNull())
    return warned.select("name", "ordinal", "warning")
