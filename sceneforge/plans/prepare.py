"""The steps training and scoring share, so that both see the same table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sceneforge.functions import column, quoted
from sceneforge.operators.columns import (
    check_required, feature_names, fill_nulls, keep_known, target_of, tidy_columns, time_parts,
)
from sceneforge.scenes import Scene

RAW_TARGET = "_raw_target"
ROW_KEY = "_row_key"

# Names the models' own columns take.
RESERVED = ("label", "features", "raw_features")


def raw_value(df: DataFrame, name: str) -> Column:
    """Target value as text, whole numbers without a fraction, so 1 and 1.0 are one class."""
    kind = df.schema[name].dataType
    value = column(name)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        value = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
        whole = value == F.floor(value)
        return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("string")
    return F.trim(value.cast("string"))


def row_key(df: DataFrame, key: Sequence[str]) -> Column:
    """Digest of the key columns, of all columns when the table has no key.

    Each value goes in with its length before it, and null as a sign of its own, so different rows have different texts.
    """
    texts = [f"CAST({quoted(c)} AS STRING)" for c in key or df.columns]
    parts = ", ".join(f"coalesce(concat(length({t}), ':', {t}), '-')" for t in texts)
    return F.expr(f"md5(CAST(concat_ws('|', {parts}) AS BINARY))")


def prepare(
    df: DataFrame, scene: Scene, key: Sequence[str] = (), training: bool = False
) -> tuple[DataFrame, list[str]]:
    """Tidy, validated, hooked and filled table plus its feature columns.

    Adds the row key and, when the target is there, its raw value.  Training
    drops rows without a target; scoring keeps them.
    """
    tidy = tidy_columns(df)
    check_required(tidy, scene, need_target=training)
    known = keep_known(tidy, scene, extra=key)
    hooked = scene.prepare(known.withColumn(ROW_KEY, row_key(known, key)))
    target = target_of(scene)
    if training and target not in hooked.columns:
        raise ValueError(f"target column {target} not found")
    marked = hooked
    if target in hooked.columns:
        marked = hooked.withColumn(RAW_TARGET, raw_value(hooked, target))
        if training:
            marked = marked.filter(F.col(RAW_TARGET).isNotNull())
    own = [ROW_KEY, RAW_TARGET]
    timed = time_parts(marked, feature_names(marked, scene, [*key, *own]))
    features = feature_names(timed, scene, [*key, *own])
    taken = sorted(set(features).intersection(RESERVED))
    if taken:
        raise ValueError(f"features must not be named {', '.join(taken)}")
    return fill_nulls(timed, skip=[target, *key, *own]), features


def add_label(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Class index of the raw target, null for an unknown or missing one."""
    if RAW_TARGET not in df.columns:
        return df
    indexer = StringIndexerModel.from_labels(list(classes), RAW_TARGET, "label", handleInvalid="keep")
    unknown = F.lit(float(len(classes)))
    return indexer.transform(df).withColumn("label", F.nullif(F.col("label"), unknown))


def class_names(scene: Scene, classes: Sequence[str]) -> dict[int, str]:
    """Display name per class index, by way of the raw value."""
    return {i: scene.labels.get(raw, raw) for i, raw in enumerate(classes)}
