"""Profiling a table and suggesting its target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneforge.operators import columns, frequencies, profile
from sceneforge.scenes import Scene
from sceneforge.sources.tables import read_table


@dataclass(frozen=True)
class QualityReport:
    """Profile of a table with its warnings, and how its columns differ from the scene's."""

    columns: DataFrame
    drift: DataFrame

    @property
    def warnings(self) -> DataFrame:
        return self.columns.filter(F.col("warning").isNotNull()).select("name", "ordinal", "warning")


def profile_table(df: DataFrame, scene: Scene | None = None, table: str = "input") -> QualityReport:
    """Profile and drift of a table; an empty one gives rows with zero totals."""
    tidy = columns.tidy_columns(df)
    measured = profile.add_warnings(profile.profile_columns(tidy))
    required = scene.required if scene else ()
    return QualityReport(
        columns=measured,
        drift=columns.schema_drift(columns.table_columns(tidy, table), required),
    )


def profile_stored(spark: SparkSession, path: str, scene: Scene | None = None) -> QualityReport:
    """The same for a stored table, named by its path."""
    return profile_table(read_table(spark, path), scene, path)


def suggest_target(df: DataFrame, names: Sequence[str] | None = None, samples: int = 5) -> DataFrame:
    """Per column: distinct values, sample values, whether it can be a target, and the one guessed.

    The whole table is read once for the value counts; pass ``first_rows`` of a
    table to look at a bounded sample only.
    """
    described = frequencies.describe_values(frequencies.value_frequencies(df, names), samples)
    return frequencies.guess_target(described).select(
        "column_name", "ordinal", "distinct_values", "is_candidate", "is_guess", "sample_values"
    )


def find_target(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The guess of ``suggest_target`` from two scans that shuffle no values: no counts beyond "three and more"."""
    return frequencies.guess_target(frequencies.few_values(df, names))


def scene_draft(df: DataFrame, scene_id: str) -> Scene:
    """A scene for a table nobody configured yet: guessed target and default class names.

    Only the values of the guessed column are counted.
    """
    guess = find_target(df).filter("is_guess").first()
    counted = frequencies.value_frequencies(df, [guess.column_name])
    few = frequencies.target_values(counted, guess.column_name).collect()
    return Scene(
        scene_id=scene_id,
        target=guess.column_name,
        required=tuple(df.columns),
        labels={r.value: r.default_name for r in few},
        name=scene_id,
        description=f"Predict {guess.column_name}",
    )


