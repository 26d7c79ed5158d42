"""Column names, validation, selection, null filling and label casts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sceneforge.functions import column, is_numeric, is_text, is_time, look_up, quoted
from sceneforge.scene_catalog import KEPT_IDS, NEVER_FEATURES
from sceneforge.scenes import Scene

# The messages of the schema comparison.
NO_SCHEMA = "No schema defined for this scene"
MISSING_COLUMNS = "Missing %d required feature columns"
EXTRA_COLUMNS = "Found %d extra columns (will be ignored)"
ALL_MATCH = "All columns match perfectly"

_TO_UNDERSCORE = str.maketrans({".": "_", " ": "_"})


def tidy_name(name: str) -> str:
    """Trimmed, with dots and spaces as underscores."""
    return name.strip().translate(_TO_UNDERSCORE)


def tidy_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its tidy name; two columns must not end up with one name."""
    names = [tidy_name(c) for c in df.columns]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"column names collide after tidying: {', '.join(doubled)}")
    return df.toDF(*names)


def target_of(scene: Scene) -> str:
    return tidy_name(scene.target)


def check_required(df: DataFrame, scene: Scene, need_target: bool = True) -> None:
    """Raise when required columns are missing, naming the first five.

    Unlabeled tables can be scored, so the target is only demanded for training.
    """
    if not scene.required:
        return
    wanted = set(scene.required) - (set() if need_target else {target_of(scene)})
    missing = sorted(wanted.difference(df.columns))
    if missing:
        named = ", ".join(missing[:5]) + ("..." if len(missing) > 5 else "")
        raise ValueError(f"{len(missing)} required columns are missing: {named}")


def keep_known(df: DataFrame, scene: Scene, extra: Sequence[str] = ()) -> DataFrame:
    """Only the columns the scene knows, in table order; all of them when it lists none."""
    if not scene.required:
        return df
    known = {*scene.required, target_of(scene), *scene.helpers, *extra}
    return df.selectExpr(*[quoted(c) for c in df.columns if c in known or c.lower() in KEPT_IDS])


def feature_names(df: DataFrame, scene: Scene, key: Sequence[str] = ()) -> list[str]:
    """Feature columns, for training and scoring alike: no target, ids, time or ignored names."""
    out = {target_of(scene), *scene.ignored, *key}
    return [c for c in df.columns if c not in out and c.lower() not in NEVER_FEATURES]


def numeric_names(df: DataFrame, among: Sequence[str]) -> list[str]:
    """Those columns a feature vector takes as they are."""
    return [
        f.name
        for f in df.schema.fields
        if f.name in among and (is_numeric(f) or isinstance(f.dataType, T.BooleanType))
    ]


def fill_nulls(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Numbers become 0 (NaN too), text becomes 'Unknown', booleans become false."""
    return df.selectExpr(
        *[quoted(f.name) if f.name in skip else f"{_filled(f)} AS {quoted(f.name)}" for f in df.schema.fields]
    )


def _filled(field: T.StructField) -> str:
    """SQL text of the column with its type's default in place of missing values."""
    name, kind = quoted(field.name), field.dataType.simpleString()
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return f"coalesce(nanvl({name}, NULL), CAST(0 AS {kind}))"
    if is_numeric(field):
        return f"coalesce({name}, CAST(0 AS {kind}))"
    if is_text(field):
        return f"coalesce({name}, 'Unknown')"
    if isinstance(field.dataType, T.BooleanType):
        return f"coalesce({name}, false)"
    return name


def time_parts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace date and time features by numbers a feature vector accepts."""
    timed = [f.name for f in df.schema.fields if f.name in names and is_time(f)]
    for name in timed:
        day = column(name)
        df = df.withColumns(
            {
                f"{name}_year": F.year(day),
                f"{name}_month": F.month(day),
                f"{name}_weekday": F.dayofweek(day),
                f"{name}_hour": F.hour(day.cast("timestamp_ntz")),
            }
        )
    return df.drop(*timed)


def numeric_label(name: str) -> Column:
    """Label as double; text that is no number becomes null instead of an error."""
    return column(name).try_cast("double")


def remap_label(df: DataFrame, name: str, codes: Mapping, label: str = "label") -> DataFrame:
    """Keep rows whose raw value has a code and add the code as the label.

    The filter is on the bare column, so it reaches the scan.
    """
    return df.filter(column(name).isin(list(codes))).withColumn(label, look_up(column(name), codes))


# --- schema drift over many tables ----------------------------------------------------


def populated_columns(df: DataFrame, table: Column, columns: Sequence[str]) -> DataFrame:
    """``table_name, column_name`` of the columns that hold any value in each delivered table.

    One aggregation for all columns; the result has at most tables x columns rows.
    """
    flags = [F.max(column(c).isNotNull()).alias(c) for c in columns]
    wide = df.groupBy(table.alias("table_name")).agg(*flags)
    names = F.array(*[F.when(column(c), F.lit(c)) for c in columns])
    return wide.select("table_name", F.explode(F.array_compact(names)).alias("column_name"))


def table_columns(df: DataFrame, table: str) -> DataFrame:
    """The same two columns from a table's schema alone."""
    rows = [(table, c) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string")


def schema_drift(actual: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per table: missing, extra and matching columns against the required ones, and a message.

    ``actual`` has ``table_name, column_name``.  Missing, extra and matching
    are set operations per table; the sets are column lists, so they are small.
    """
    wanted = F.array(*[F.lit(c) for c in sorted(set(required))]).cast("array<string>")
    per_table = actual.groupBy("table_name").agg(F.collect_set("column_name").alias("have"))
    named = per_table.select(
        "table_name",
        F.array_sort(F.array_except(wanted, "have")).alias("missing"),
        F.array_sort(F.array_except("have", wanted)).alias("extra"),
        F.size(F.array_intersect("have", wanted)).alias("matching_count"),
        F.size("have").alias("actual_cols"),
    )
    n_missing, n_extra = F.size("missing"), F.size("extra")
    return named.select(
        "table_name",
        (n_missing == 0).alias("is_match"),
        F.lit(len(set(required))).alias("required_cols"),
        "actual_cols",
        "matching_count",
        n_missing.alias("missing_count"),
        n_extra.alias("extra_count"),
        F.slice("missing", 1, 10).alias("missing_cols"),
        F.slice("extra", 1, 10).alias("extra_cols"),
        F.when(F.lit(not required), F.lit(NO_SCHEMA))
        .when(n_missing > 0, F.format_string(MISSING_COLUMNS, n_missing))
        .when(n_extra > 0, F.format_string(EXTRA_COLUMNS, n_extra))
        .otherwise(ALL_MATCH)
        .alias("message"),
    )


def missing_columns(actual: DataFrame, required: DataFrame) -> DataFrame:
    """Required columns a table lacks, both sides as tables (``table_name, column_name``)."""
    return required.join(actual, ["table_name", "column_name"], "left_anti")


def extra_columns(actual: DataFrame, required: DataFrame) -> DataFrame:
    return actual.join(required, ["table_name", "column_name"], "left_anti")


def matching_columns(actual: DataFrame, required: DataFrame) -> DataFrame:
    return actual.join(required, ["table_name", "column_name"], "left_semi")

