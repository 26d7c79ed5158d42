"""Scoring runs as an append-only log.

Each step of a run appends one row with only the fields it changes; the state
of a run is the last value of each field.  All states are reductions, so a run
with very many rows is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sceneforge.sources.results import RESULT_SCHEMA, decode

LOG_SCHEMA = (
    "task_id long, seq long, scene_type string, predict_time timestamp, finish_time timestamp, "
    "file_path string, model_type string, accuracy double, status string, result_json string, "
    "current_model string, model_progress_status string"
)

STATE_FIELDS = (
    "scene_type", "predict_time", "finish_time", "file_path", "model_type", "accuracy",
    "status", "result_json", "current_model", "model_progress_status",
)
HISTORY_FIELDS = (
    "task_id", "scene_type", "predict_time", "finish_time", "file_path", "model_type", "accuracy", "status",
)

# Texts the states of a run are shown with.
OPEN = {"status": "processing", "current_model": "None", "model_progress_status": "Task queued..."}
CLOSED = {"current_model": "None", "model_progress_status": "Complete"}
NO_SCENE = "unknown"
READING = "Reading data / preprocessing..."
REPORTING = "Generating report..."


def scene_or_unknown(scene: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(scene), F.lit("")), F.lit(NO_SCENE))


def open_rows(requests: DataFrame) -> DataFrame:
    """First log row of each run, from ``task_id, seq, scene_type, file_path, model_type, predict_time`` (K6)."""
    fixed = {name: F.lit(text) for name, text in OPEN.items()}
    return requests.withColumns(
        {"scene_type": scene_or_unknown(F.col("scene_type")), "accuracy": F.lit(0.0), **fixed}
    )


def progress_rows(updates: DataFrame) -> DataFrame:
    """Partial rows from ``task_id, seq`` and any of ``current_model, model_progress_status`` (K7)."""
    given = [c for c in ("current_model", "model_progress_status") if c in updates.columns]
    return updates.select("task_id", "seq", *given)


def close_rows(results: DataFrame) -> DataFrame:
    """Last row of each run, from ``task_id, seq, accuracy, status, result_json, finish_time`` (K8)."""
    return results.select(
        "task_id", "seq", "accuracy", "status", "result_json", "finish_time"
    ).withColumns({name: F.lit(text) for name, text in CLOSED.items()})


def latest_state(log: DataFrame) -> DataFrame:
    """One row per run: of every field the last value that was set."""
    fields = [c for c in STATE_FIELDS if c in log.columns]

    def last(name: str) -> Column:
        set_at = F.when(F.col(name).isNotNull(), F.col("seq"))
        return F.max_by(name, set_at).alias(name)

    return log.groupBy("task_id").agg(F.max("seq").alias("seq"), *[last(f) for f in fields])


def task_status(log: DataFrame, task_id: int, schema: str = RESULT_SCHEMA) -> DataFrame:
    """State of one run with its parsed result; the filter reaches the scan."""
    state = latest_state(log.filter(F.col("task_id") == task_id))
    return state.withColumn("result", decode(F.col("result_json"), schema)).drop("result_json")


def history(log: DataFrame, scene: str | None = None) -> DataFrame:
    """All runs, newest first, of one scene when a name is given."""
    state = latest_state(log)
    fields = [c for c in HISTORY_FIELDS if c in state.columns]
    if scene is not None and scene.strip():
        state = state.filter(F.col("scene_type") == scene)
    return state.select(*fields).orderBy(F.desc("task_id"))


def time_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


# --- the stored log ---------------------------------------------------------------------


def append_log(rows: DataFrame, path: str) -> None:
    whole = rows.sparkSession.createDataFrame([], LOG_SCHEMA).unionByName(rows, allowMissingColumns=True)
    whole.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)
