"""Model versions as an append-only event table.

Two kinds of events share one table: ``register`` (one row per algorithm of a
version, with its metrics and calibration) and ``activate``.  Nothing is
updated in place; states are reductions over the events, and the latest event,
by ``seq``, wins.  Reductions shrink every scene before the shuffle, so a scene
that holds most events is no hot spot.

Every append is a folder of its own, so appends at one time do not meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sceneforge.operators.scoring import CANDIDATES

EVENT_SCHEMA = (
    "scene_id string, version int, algo string, event string, seq long, event_time timestamp, "
    "dataset string, rows long, models_subdir string, model_path string, "
    "accuracy double, f1_score double, train_size long, num_classes int, "
    "threshold double, slope double, intercept double, "
    "tuned_accuracy double, tuned_f1 double, class_values array<string>, "
    "slots array<string>, wide_columns array<string>, "
    "features array<struct<name: string, value: double>>"
)

FIRST_VERSION = 1

# What activating a version answers.
NOT_FOUND = "Version %d not found"
SWITCHED = "Switched to v%d"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def subdir(version: Column) -> Column:
    """Folder of a version's models; the first version lies at the root."""
    return F.when(version == FIRST_VERSION, F.lit("")).otherwise(F.concat(F.lit("v"), version.cast("string")))


def register_events(rows: DataFrame) -> DataFrame:
    """Registration events from ``scene_id, version, algo, seq`` and any metric columns; ``event_time`` may be unknown."""
    when = F.col("event_time") if "event_time" in rows.columns else F.lit(None).cast("timestamp")
    return rows.withColumns({"event": F.lit("register"), "models_subdir": subdir(F.col("version")), "event_time": when})


def activate_events(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Activation events from ``scene_id, version, seq``; requests for unknown versions are left out (K3)."""
    known = events.filter(F.col("event") == "register").select("scene_id", "version").distinct()
    return requests.join(known, ["scene_id", "version"], "left_semi").withColumn("event", F.lit("activate"))


def unknown_requests(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Activation requests that name no registered version, with the message to show."""
    known = events.filter(F.col("event") == "register").select("scene_id", "version").distinct()
    refused = requests.join(known, ["scene_id", "version"], "left_anti")
    return refused.withColumn("message", F.format_string(NOT_FOUND, F.col("version")))


def latest_models(events: DataFrame) -> DataFrame:
    """One row per scene, version and algorithm: the last registration of each, and when that was."""
    registered = events.filter(F.col("event") == "register")
    keys = ["scene_id", "version", "algo"]
    fields = [c for c in registered.columns if c not in (*keys, "event")]
    last = F.max_by(F.struct(*fields), "seq").alias("last")
    latest = registered.groupBy(*keys).agg(last).select(*keys, "last.*")
    return latest.withColumn("trained_at", F.date_format("event_time", TIME_FORMAT))


def version_heads(events: DataFrame) -> DataFrame:
    """``scene_id, current_version, next_version, n_versions`` per scene.

    The current version is the one of the last event of any kind; of events at one time, the newest version's.
    """
    registered = F.when(F.col("event") == "register", F.col("version"))
    return events.groupBy("scene_id").agg(
        F.max_by("version", F.struct("seq", "version")).alias("current_version"),
        (F.coalesce(F.max(registered), F.lit(0)) + 1).alias("next_version"),
        F.count_distinct(registered).alias("n_versions"),
    )


def next_version(events: DataFrame, scene_id: str) -> int:
    registered = (F.col("scene_id") == scene_id) & (F.col("event") == "register")
    return events.filter(registered).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]


def current_location(events: DataFrame) -> DataFrame:
    """Where each scene's current models lie: ``scene_id, current_version, models_subdir`` (K5)."""
    return version_heads(events).select(
        "scene_id", "current_version", subdir(F.col("current_version")).alias("models_subdir")
    )


def list_versions(events: DataFrame) -> DataFrame:
    """Versions of every scene, when they were trained, the metrics of their models as a map, the current flag."""
    metrics = F.struct("accuracy", "f1_score", "train_size")
    per_version = latest_models(events).groupBy("scene_id", "version").agg(
        F.max("seq").alias("registered_seq"),
        F.max_by("trained_at", "seq").alias("trained_at"),
        F.max_by("dataset", "seq").alias("dataset"),
        F.max_by("rows", "seq").alias("rows"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("algo", metrics.alias("metrics"))))).alias("models"),
    )
    heads = version_heads(events).select("scene_id", "current_version")
    return per_version.join(heads, "scene_id").select(
        "scene_id",
        "version",
        "registered_seq",
        "trained_at",
        "dataset",
        "rows",
        subdir(F.col("version")).alias("models_subdir"),
        "models",
        (F.col("version") == F.col("current_version")).alias("is_current"),
    )


def status_grid(scenes: DataFrame, events: DataFrame, algos: Sequence[str] = CANDIDATES) -> DataFrame:
    """Every scene with every algorithm, and what its current version knows of it.

    Scenes without any version count as version 1, untrained.
    """
    heads = version_heads(events).select("scene_id", "current_version")
    models = latest_models(events).select(
        "scene_id", F.col("version").alias("current_version"), "algo", "accuracy", "f1_score", "trained_at"
    )
    cells = (
        scenes.select("scene_id")
        .join(heads, "scene_id", "left")
        .withColumn("current_version", F.coalesce("current_version", F.lit(FIRST_VERSION)))
        .withColumn("algo", F.explode(F.array(*[F.lit(a) for a in algos])))
    )
    found = models.withColumn("trained", F.lit(True))
    return cells.join(found, ["scene_id", "current_version", "algo"], "left").withColumns(
        {
            "trained": F.coalesce("trained", F.lit(False)),
            "training": F.when(F.coalesce("trained", F.lit(False)), F.lit("completed")).otherwise(F.lit("idle")),
        }
    )


# --- the stored table -------------------------------------------------------------------


def append_events(events: DataFrame, path: str) -> None:
    """Append events; columns the event does not have are stored as null."""
    spark = events.sparkSession
    whole = spark.createDataFrame([], EVENT_SCHEMA).unionByName(events, allowMissingColumns=True)
    whole.write.partitionBy("scene_id").parquet(f"{path}/batch=b{uuid.uuid4().hex}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{EVENT_SCHEMA}, batch string").parquet(path).drop("batch")
