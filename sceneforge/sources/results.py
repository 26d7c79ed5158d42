"""Scoring results as JSON text, partitioned by scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

RESULT_SCHEMA = (
    "accuracy double, f1 double, final_model string, "
    "distribution array<struct<name: string, value: bigint>>, "
    "confusion_matrix array<struct<pred_pos: int, true_pos: int, cnt: bigint>>, "
    "all_labels_indices array<string>, "
    "feature_importance array<struct<name: string, value: double>>, "
    "classification_report array<struct<name: string, precision: double, recall: double, f1: double, support: bigint>>, "
    "chart_data array<struct<id: bigint, actual: string, predicted: string, confidence: double>>"
)


def encode(*fields: str | Column) -> Column:
    """JSON text of the given columns; nulls are left out."""
    return F.to_json(F.struct(*fields))


def decode(text: Column, schema: str = RESULT_SCHEMA) -> Column:
    """Parsed JSON; null for text that is not valid JSON, and for none."""
    bad = "_not_json"
    parsed = F.from_json(
        text, f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    )
    good = F.struct(*[parsed[n].alias(n) for n in T.DataType.fromDDL(schema).fieldNames()])
    return F.when(parsed.isNotNull() & parsed[bad].isNull(), good)


def append_results(df: DataFrame, path: str) -> None:
    """Append result rows; ``df`` has ``scene_id`` and a JSON column ``result_json``."""
    df.write.mode("append").partitionBy("scene_id").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("result", decode(F.col("result_json")))
