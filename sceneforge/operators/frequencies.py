"""Value frequencies, distinct counts and the guess of a target column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sceneforge.functions import quoted, text
from sceneforge.session import write_out

# Words that mark a target column, most telling first.
TARGET_WORDS = (
    "class", "label", "target", "churn", "failure", "quality",
    "severity", "ordered", "satisfaction", "fraud", "del15", "y_n",
)

SAMPLE_VALUES = 5


def first_rows(df: DataFrame, order: Sequence[str | Column], rows: int = 5000) -> DataFrame:
    """A bounded sample: the first rows by a key, so the same ones every time.

    It is picked once and written out, since what follows reads it several times.
    """
    return write_out(df.orderBy(*order).limit(rows), "sample")


def _kind(field: T.StructField) -> str:
    """Type under which a column's values are counted before they become text."""
    if isinstance(field.dataType, T.IntegralType):
        return "bigint"
    if isinstance(field.dataType, (T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return field.dataType.simpleString()
    return "string"


def _counted(df: DataFrame, kind: str, places: Sequence[tuple[int, str]]) -> DataFrame:
    shown = "coalesce(trim(CAST({0} AS STRING)), '')" if kind == "string" else "CAST({0} AS " + kind + ")"
    cells = ", ".join(f"{i}, {shown.format(quoted(c))}" for i, c in places)
    counts = (
        df.selectExpr(f"stack({len(places)}, {cells}) AS (ordinal, value)")
        .groupBy("ordinal", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counts.selectExpr("ordinal", "coalesce(CAST(value AS STRING), '') AS value", "cnt")


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, ordinal, value, cnt`` over the whole table.

    Values are told apart as trimmed text and a missing one counts as ''.  Rows
    are counted per task before the shuffle, so a value held by a third of the
    table costs one row per task.  Numbers and times are counted as such, in
    one part of the job per type, and only distinct ones become text.
    """
    names = list(df.columns if columns is None else columns)
    parts: dict[str, list[tuple[int, str]]] = {}
    for i, c in enumerate(names):
        parts.setdefault(_kind(df.schema[c]), []).append((i, c))
    counted = reduce(DataFrame.unionByName, [_counted(df, kind, places) for kind, places in parts.items()])
    listed = ", ".join(map(text, names))
    return counted.selectExpr(f"array({listed})[ordinal] AS column_name", "ordinal", "value", "cnt")


def distinct_counts(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("column_name", "ordinal").agg(F.count(F.lit(1)).alias("distinct_values"))


def top_values(frequencies: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """The k most frequent values per column, ties by value; ``rank`` starts at 1.

    Spark cuts every partition down to k rows per column before the shuffle
    (window group limit), so no column meets in one task as a whole.
    """
    order = Window.partitionBy("column_name", "ordinal").orderBy(F.desc("cnt"), F.asc("value"))
    return frequencies.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sample_values(frequencies: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """Per column the array of its k most frequent values."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "value")))
    return top_values(frequencies, k).groupBy("column_name", "ordinal").agg(
        ranked["value"].alias("sample_values")
    )


def target_values(frequencies: DataFrame, target: str) -> DataFrame:
    """Values of one column by falling count, with the default display name of each."""
    return (
        frequencies.filter(F.col("column_name") == target)
        .select("value", "cnt", F.concat(F.lit("Class_"), "value").alias("default_name"))
        .orderBy(F.desc("cnt"), F.asc("value"))
    )


def describe_values(frequencies: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """Distinct count and most frequent values per column.

    The counts are read twice, so they are written out first; the table they
    come from is read once.
    """
    kept = write_out(frequencies, "frequencies")
    shown = sample_values(kept, k).select("ordinal", "sample_values")
    return distinct_counts(kept).join(shown, "ordinal")


# Columns whose ends one aggregation finds.
COLUMNS_PER_PASS = 24


def few_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column whether it has one, two or more values, without a shuffled row per value.

    ``distinct_values`` is exact up to 2, and 3 stands for three and more; ``values`` are the one or two as text.
    Values are told apart as ``value_frequencies`` does it. The first scan reduces each column to its smallest
    and largest value, the second looks for any value between; both give a row per task.
    """
    names = list(df.columns if columns is None else columns)
    kinds = {c: _kind(df.schema[c]) for c in names}
    shown = {}
    for c, kind in kinds.items():
        as_kind = f"CAST({quoted(c)} AS {kind})"
        shown[c] = {"string": f"coalesce(trim({as_kind}), '')", "double": f"{as_kind} + 0D"}.get(kind, as_kind)
    ends: dict[str, tuple[str | None, str | None, int]] = {}
    for at in range(0, len(names), COLUMNS_PER_PASS):
        some = names[at : at + COLUMNS_PER_PASS]
        found = [f"CAST({fn}({shown[c]}) AS STRING) AS {quoted(f'{fn}:{c}')}" for c in some for fn in ("min", "max")]
        row = df.selectExpr(*found, *[f"count_if({shown[c]} IS NULL) AS {quoted('n:' + c)}" for c in some]).first()
        ends.update({c: (row[f"min:{c}"], row[f"max:{c}"], row[f"n:{c}"]) for c in some})
    apart = [c for c in names if ends[c][0] != ends[c][1]]
    more: set[str] = set()
    for at in range(0, len(apart), COLUMNS_PER_PASS):
        some = apart[at : at + COLUMNS_PER_PASS]
        end = lambda c, k: f"CAST({text(ends[c][k])} AS {kinds[c]})"
        row = df.selectExpr(*[f"bool_or({shown[c]} > {end(c, 0)} AND {shown[c]} < {end(c, 1)}) AS {quoted(c)}" for c in some]).first()
        more.update(c for c in some if row[c])
    rows = []
    for i, c in enumerate(names):
        low, high, gaps = ends[c]
        values = sorted({*([""] if gaps else []), *(v for v in (low, high) if v is not None)})
        few = c not in more and len(values) <= 2
        rows.append((c, i, len(values) if few else 3, values if few else None))
    return df.sparkSession.createDataFrame(rows, "column_name string, ordinal int, distinct_values long, `values` array<string>")


def word_rank(name: Column) -> Column:
    """Position of the first target word the lower-cased name contains; null without one."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(i)) for i, w in enumerate(TARGET_WORDS)])


def guess_target(distinct: DataFrame) -> DataFrame:
    """Add ``is_candidate`` (at most two values), ``word_rank`` and ``is_guess`` to the distinct counts.

    The guess is the candidate with the most telling word, the earliest column
    among equals; with none, the last column.  There is one row per column, so
    gathering them in one row is bounded by the table's width.
    """
    marked = distinct.withColumn("is_candidate", F.col("distinct_values") <= 2).withColumn(
        "word_rank", F.when(F.col("is_candidate"), word_rank(F.col("column_name")))
    )
    others = [c for c in distinct.columns if c not in ("column_name", "ordinal", "distinct_values")]
    fields = F.struct("column_name", "ordinal", "distinct_values", "is_candidate", "word_rank", *others)
    telling = F.when(F.col("word_rank").isNotNull(), F.struct("word_rank", "ordinal"))
    whole = marked.agg(
        F.coalesce(F.min_by("ordinal", telling), F.max("ordinal")).alias("guess"),
        F.collect_list(fields).alias("entries"),
    )
    return whole.select("guess", F.inline("entries")).select(
        "column_name",
        "ordinal",
        "distinct_values",
        "is_candidate",
        "word_rank",
        (F.col("ordinal") == F.col("guess")).alias("is_guess"),
        *others,
    )
