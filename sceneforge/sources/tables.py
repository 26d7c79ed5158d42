"""CSV and Parquet tables, and discovery of scene tables in a folder (A1-A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sceneforge.scenes import Scene

# A table file or folder is named <scene>[_clean].<csv|parquet>.
_TABLE_NAME = r"([^/]+)\.(csv|parquet)(?:/[^/]*)?$"
_TABLE_PATH = r"^(.*?\.(?:csv|parquet))(?:/[^/]*)?$"
_CLEAN_SUFFIX = r"_clean$"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line; types are inferred (one extra pass) only when no schema is given."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Read Parquet when the path says so (or ``fmt`` does), CSV otherwise."""
    kind = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind != "parquet":
        raise ValueError(f"unknown table format {kind!r}")
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def scene_of_path(path):
    """Scene id of a table path, as a column expression: the stem without ``_clean``."""
    return F.regexp_replace(F.regexp_extract(path, _TABLE_NAME, 1), _CLEAN_SUFFIX, "")


def discover_tables(spark: SparkSession, folder: str, scenes: dict[str, Scene]) -> DataFrame:
    """Files of configured scenes under a folder: ``scene_id, table_path, bytes, files``.

    The listing is itself a DataFrame and only file metadata is read, so a
    folder with very many part files is no burden on the driver.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length")
    )
    known = F.col("scene_id").isin(list(scenes))
    return (
        listing.withColumn("table_path", F.regexp_extract("path", _TABLE_PATH, 1))
        .withColumn("scene_id", scene_of_path(F.col("path")))
        .filter(known)
        .groupBy("scene_id", "table_path")
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
    )


def read_with_scene(reader: DataFrame, scenes: dict[str, Scene]) -> DataFrame:
    """Tag every row of a multi-file read with the scene its file belongs to; drop unknown scenes."""
    return reader.withColumn("scene_id", scene_of_path(F.col("_metadata.file_path"))).filter(
        F.col("scene_id").isin(list(scenes))
    )
