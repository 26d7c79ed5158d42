"""Queries whose results depend on a learned model; they have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneforge.operators import registry, runlog, scoring
from sceneforge.plans.score import Scorer, run_logged, score_table
from sceneforge.plans.train import known_events, train_folder, train_scene
from sceneforge.scenes import Scene, keep_values
from sceneforge.session import scratch_path
from sceneforge.workload import query
from sceneforge.workload.inputs import labeled_documents, scored_lines, table

DOC_QUALITY = Scene("doc_quality", "quality", labels={"0": "Poor", "1": "Good"})
ORDER_STATUS = Scene("order_status", "o_orderstatus", labels={"F": "Filled", "O": "Open", "P": "Pending"})
ORDER_OPEN = Scene(
    "order_open", "o_orderstatus", labels={"F": "Filled", "O": "Open"}, hook=keep_values("o_orderstatus", ["F", "O"])
)

PART_BAND = Scene("part_band", "band", labels={"small": "Small", "medium": "Medium", "large": "Large"})


def _train_and_score(
    spark: SparkSession, df: DataFrame, scene: Scene, key: list[str], algos: list[str], model: str
) -> DataFrame:
    """Train, save, load and score; one row per scored input row."""
    root = scratch_path(spark, "models")
    train_scene(df, scene, root, key=key, algos=algos)
    scored = score_table(df, Scorer(spark, scene, root, key), model)
    return scored.rows.select(
        *key, F.lit(scored.model).alias("model"), "label", "prediction", "predicted", F.round("confidence", 6).alias("confidence")
    )


def _documents(algos: list[str], model: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _train_and_score(spark, labeled_documents(spark, sf_dir), DOC_QUALITY, ["doc_id"], algos, model)

    return run


@query()
def train_score_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest."""
    return _documents(["random_forest"], "random_forest")(spark, sf_dir)


@query()
def train_score_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted trees."""
    return _documents(["gbdt"], "gbdt")(spark, sf_dir)


@query()
def train_score_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes."""
    return _documents(["naive_bayes"], "naive_bayes")(spark, sf_dir)


@query()
def train_score_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regularised boosting, a hundred rounds."""
    return _documents(["xgboost"], "xgboost")(spark, sf_dir)


@query()
def train_score_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates trained, the best one chosen on the table at hand."""
    return _documents(list(scoring.CANDIDATES), "auto")(spark, sf_dir)


@query("""
WITH p AS (SELECT CASE WHEN p_size <= 15 THEN 'small' WHEN p_size <= 35 THEN 'medium' ELSE 'large' END AS band FROM part)
SELECT band AS class, upper(band[1]) || band[2:] AS predicted, count(*) AS n_rows, count(*) AS n_sure, count(*) AS n_probable FROM p GROUP BY ALL
""")
def boosted_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regularised boosting on three classes that follow from one column, a hundred rounds.

    Learned from the training share, every part gets its band; ``n_sure`` counts confidences above a half
    and ``n_probable`` those that are probabilities.
    """
    band = F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 35, "medium").otherwise("large")
    parts = table(spark, sf_dir, "part").withColumn("band", band)
    root = scratch_path(spark, "models")
    train_scene(parts, PART_BAND, root, key=["p_partkey"], algos=["xgboost"])
    rows = score_table(parts, Scorer(spark, PART_BAND, root, ["p_partkey"]), "xgboost").rows
    sure = F.col("confidence")
    return rows.groupBy(F.col("band").alias("class"), "predicted").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(sure > 0.5).alias("n_sure"), F.count_if(sure.between(0, 1)).alias("n_probable"))


@query()
def train_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes, a forest and naive Bayes; ``boosted_bands`` has the boosted trees on three classes."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return _train_and_score(spark, orders, ORDER_STATUS, ["o_orderkey", "o_custkey"], ["random_forest", "naive_bayes"], "auto")


@query()
def learned_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features a forest relies on most, by the names of its vector's slots."""
    root = scratch_path(spark, "models")
    train_scene(labeled_documents(spark, sf_dir), DOC_QUALITY, root, key=["doc_id"], algos=["random_forest"])
    stored = registry.latest_models(known_events(spark, root)).select(F.inline("features"))
    return scoring.top_importances(stored).withColumn("value", F.round("value", 6))


@query()
def train_every_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scene with a table in a folder trained; one registry row per model."""
    folder, root = scratch_path(spark, "datasets"), scratch_path(spark, "models")
    orders = table(spark, sf_dir, "orders").drop("o_orderdate").withColumnRenamed("o_orderkey", "id")
    orders.write.option("header", True).csv(f"{folder}/order_open_clean.csv")
    labeled_documents(spark, sf_dir).write.parquet(f"{folder}/doc_quality.parquet")
    table(spark, sf_dir, "nation").write.parquet(f"{folder}/no_scene.parquet")
    scenes = {"order_open": ORDER_OPEN, "doc_quality": DOC_QUALITY}
    train_folder(spark, folder, root, scenes, algos=["naive_bayes"])
    listed = registry.latest_models(known_events(spark, root))
    return listed.select(
        "scene_id", "version", "algo", "rows", "num_classes", F.round("accuracy", 6).alias("accuracy"),
        F.round("f1_score", 6).alias("f1_score"), F.round("tuned_f1", 6).alias("tuned_f1"), "threshold",
    )


@query()
def scored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table scored as a logged run; the run's final state and result."""
    root, path = scratch_path(spark, "models"), scratch_path(spark, "input") + ".parquet"
    log, results = scratch_path(spark, "log"), scratch_path(spark, "results")
    documents = labeled_documents(spark, sf_dir)
    documents.write.parquet(path)
    train_scene(documents, DOC_QUALITY, root, key=["doc_id"], algos=["naive_bayes"])
    run_logged(spark, path, DOC_QUALITY, root, log, results, task_id=1, key=["doc_id"])
    state = runlog.task_status(runlog.read_log(spark, log), 1)
    return state.select(
        "task_id", "scene_type", "model_type", "status", "current_model", "model_progress_status",
        F.round("accuracy", 6).alias("accuracy"),
        F.col("result.final_model").alias("final_model"),
        F.size("result.chart_data").alias("previewed"),
        F.aggregate("result.confusion_matrix", F.lit(0).cast("long"), lambda n, c: n + c["cnt"]).alias("measured"),
        F.aggregate("result.distribution", F.lit(0).cast("long"), lambda n, d: n + d["value"]).alias("scored"),
    )


@query()
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration line fitted on scored rows, then the calibrated table by class."""
    scored = scored_lines(spark, sf_dir)
    slope, intercept = scoring.fit_calibration(scored)
    return scored.groupBy(F.col("label").cast("int").cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(scoring.calibrated(F.col("raw1"), slope, intercept)), 4).alias("mean_calibrated"),
        F.lit(round(slope, 4)).alias("slope"),
        F.lit(round(intercept, 4)).alias("intercept"),
    )
