"""Training all algorithms of a scene, and of every scene in a folder."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sceneforge.functions import quoted
from sceneforge.operators import balance, features as feat, learners, metrics, registry, scoring
from sceneforge.plans.prepare import RAW_TARGET, ROW_KEY, add_label, prepare
from sceneforge.scenes import Scene, load_scenes
from sceneforge.session import claim, ensure_checkpoints, release
from sceneforge.sources.tables import discover_tables, read_table

# Learn, then calibrate and tune on rows not learned from, then report on rows not tuned on.
SHARES = (("train", 60), ("tune", 20), ("test", 20))


def registry_path(models_root: str) -> str:
    return f"{models_root}/registry"


def version_folder(models_root: str, version: int) -> str:
    return models_root if version == registry.FIRST_VERSION else f"{models_root}/v{version}"


def claim_path(models_root: str, scene_id: str, version: int) -> str:
    return f"{models_root}/claims/{scene_id}/v{version}"


def claim_version(spark: SparkSession, models_root: str, scene_id: str) -> int:
    """The next version of a scene, which no other training gets from now on, registered or not (K2)."""
    version = registry.next_version(known_events(spark, models_root), scene_id)
    while not claim(spark, claim_path(models_root, scene_id, version)):
        version += 1
    return version


def wide_path(folder: str, scene_id: str, name: str) -> str:
    return f"{folder}/{scene_id}.index/{name}"


def known_events(spark: SparkSession, models_root: str) -> DataFrame:
    """The registry so far; empty before the first training."""
    try:
        return registry.read_events(spark, registry_path(models_root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], registry.EVENT_SCHEMA)


def train_scene(
    df: DataFrame,
    scene: Scene,
    models_root: str,
    key: Sequence[str] = (),
    algos: Sequence[str] | None = None,
    rounds: int | None = None,
    dataset: str = "",
    scale: bool = True,
    max_categories: int = feat.INDEXER_CATEGORIES,
) -> DataFrame:
    """Train, calibrate, tune, evaluate and save the scene's models; returns their registry rows.

    The new version becomes the current one, once, after all models are saved.
    Trainings of one scene at a time get versions and folders of their own. An
    error is raised, not logged away, and gives the version back.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    version = claim_version(spark, models_root, scene.scene_id)
    try:
        entries = _train_version(df, scene, models_root, version, key, algos, rounds, dataset, scale, max_categories)
    except BaseException:
        release(spark, claim_path(models_root, scene.scene_id, version))
        raise
    events = registry.register_events(
        spark.createDataFrame([tuple(e.values()) for e in entries], _entry_schema(entries)).withColumn("event_time", F.current_timestamp())
    )
    registry.append_events(events, registry_path(models_root))
    return events


def _train_version(
    df: DataFrame,
    scene: Scene,
    models_root: str,
    version: int,
    key: Sequence[str],
    algos: Sequence[str] | None,
    rounds: int | None,
    dataset: str,
    scale: bool,
    max_categories: int,
) -> list[dict]:
    """Train and save the models of a version; returns a registry entry for each."""
    folder = version_folder(models_root, version)
    prepared, names = prepare(df, scene, key, training=True)
    prepared = prepared.selectExpr(ROW_KEY, RAW_TARGET, *map(quoted, names))
    prepared.persist(StorageLevel.MEMORY_AND_DISK)
    ready = None
    try:
        plan = feat.plan_features(prepared, names, RAW_TARGET, max_categories)
        classes, indexer = feat.fit_indexes(prepared, plan, RAW_TARGET)
        if len(classes) < 2:
            raise ValueError(f"scene {scene.scene_id} has {len(classes)} classes, two are needed")
        table, wide_sizes = _index_wide(prepared, plan, folder, scene.scene_id)
        stages = feat.feature_stages(plan, indexer, wide_sizes, scale)

        ready = feat.transform_with(add_label(table, classes), stages).select(
            "features", "label", ROW_KEY, balance.split_name([ROW_KEY], SHARES).alias("part")
        )
        ready = balance.deal(ready, [ROW_KEY])  # a class may lie in a few files only
        ready.persist(StorageLevel.MEMORY_AND_DISK)
        rows = ready.count()
        prepared.unpersist()
        train = balance.oversample(
            ready.filter(F.col("part") == "train"), [ROW_KEY], cap=scene.oversample_cap
        ).select("features", "label")
        models = {}
        for algo in algos or learners.algorithms_for(len(classes)):
            models[algo] = learners.classifier(algo, len(classes), rounds).fit(train)
            path = _model_path(folder, scene, algo)
            PipelineModel([*stages.stages, models[algo]]).write().overwrite().save(path)
        measured = _evaluate(models, ready, len(classes))
    finally:
        prepared.unpersist()
        if ready is not None:
            ready.unpersist()

    stamp = time.time_ns() // 1000
    common = {
        "scene_id": scene.scene_id,
        "version": version,
        "dataset": dataset or scene.scene_id,
        "rows": rows,
        "train_size": rows,
        "num_classes": len(classes),
        "class_values": classes,
        "slots": plan.slot_names,
        "wide_columns": list(plan.wide_categories),
    }
    return [
        {
            **common,
            **measured[algo],
            "algo": algo,
            "model_path": _model_path(folder, scene, algo),
            "features": [{"name": n, "value": v} for n, v in learners.importance_pairs(model, plan.slot_names)],
            "seq": stamp + i,
        }
        for i, (algo, model) in enumerate(models.items())
    ]


def _entry_schema(entries: list[dict]) -> T.StructType:
    """The registry's types for the columns at hand, in the order of the entries."""
    return T.StructType([T.DataType.fromDDL(registry.EVENT_SCHEMA)[name] for name in entries[0]])


def _index_wide(
    table: DataFrame, plan: feat.FeaturePlan, folder: str, scene_id: str
) -> tuple[DataFrame, dict[str, int]]:
    """Write the index table of each category too wide for an indexer, and join it."""
    spark, sizes = table.sparkSession, {}
    for name in plan.wide_categories:
        where = wide_path(folder, scene_id, name)
        feat.fit_wide_index(table, name).write.mode("overwrite").parquet(where)
        index = spark.read.parquet(where)
        sizes[name] = index.count()
        table = feat.apply_wide_index(table, name, index)
    return table, sizes


def _model_path(folder: str, scene: Scene, algo: str) -> str:
    return f"{folder}/{scene.scene_id}_{algo}.model"


def _evaluate(models: dict[str, Model], ready: DataFrame, classes: int) -> dict[str, dict]:
    """Calibration and threshold from the tuning part, metrics with and without them from the test part.

    The rows held out are scored once, by all models; one sweep and one count
    then serve them all.
    """
    scored = feat.transform_with(
        ready.filter(F.col("part") != "train").select("part", "label", "features"),
        *[learners.with_output_names(m, a) for a, m in models.items()],
    )
    tuned = [a for a, m in models.items() if classes == 2 and learners.has_probability(m)]
    narrow = {f"{a}:prediction": F.col(f"{a}:prediction") for a in models}
    for a in tuned:
        narrow[f"{a}:raw1"] = F.element_at(vector_to_array(F.col(f"{a}:raw")), 2)
        narrow[f"{a}:p1"] = F.element_at(vector_to_array(F.col(f"{a}:probability")), 2)
    held_out = scored.select("part", "label", *[c.alias(n) for n, c in narrow.items()])
    held_out = held_out.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tune, test = held_out.filter(F.col("part") == "tune"), held_out.filter(F.col("part") == "test")
        lines = {a: scoring.fit_calibration(tune.select("label", F.col(f"{a}:raw1").alias("raw1"))) for a in tuned}
        thresholds = dict.fromkeys(tuned, scoring.DEFAULT_THRESHOLD)
        if tuned:
            tagged = [F.struct(F.lit(a).alias("algo"), F.col(f"{a}:p1").alias("p1")) for a in tuned]
            sweep = scoring.threshold_sweep(tune.select("label", F.inline(F.array(*tagged))), by=["algo"])
            thresholds.update({r.algo: r.threshold for r in scoring.best_threshold(sweep, by=["algo"]).collect()})
        ways = {a: F.col(f"{a}:prediction") for a in models}
        for a in tuned:
            ways[f"{a}:tuned"] = F.when(F.col(f"{a}:p1") >= thresholds[a], 1.0).otherwise(0.0)
        counts = scoring.candidate_counts(test, ways, classes=classes)
        got = {r.algo: r for r in metrics.accuracy_f1(counts, by=["algo"]).collect()}
    finally:
        held_out.unpersist()

    def metric(way: str, name: str) -> float | None:
        return float(got[way][name]) if way in got else None

    def one(algo: str) -> dict:
        final = f"{algo}:tuned" if algo in tuned else algo
        line = lines.get(algo)
        return {
            "accuracy": metric(algo, "accuracy"),
            "f1_score": metric(algo, "f1"),
            "tuned_accuracy": metric(final, "accuracy"),
            "tuned_f1": metric(final, "f1"),
            "threshold": thresholds.get(algo),
            "slope": line[0] if line else None,
            "intercept": line[1] if line else None,
        }

    return {algo: one(algo) for algo in models}


def activate(spark: SparkSession, models_root: str, scene_id: str, version: int) -> str:
    """Make another registered version the current one; an unknown one raises (K3)."""
    events = known_events(spark, models_root)
    request = spark.createDataFrame(
        [(scene_id, version, time.time_ns() // 1000)], "scene_id string, version int, seq long"
    )
    if not registry.unknown_requests(request, events).isEmpty():
        raise ValueError(registry.NOT_FOUND % version)
    accepted = registry.activate_events(request, events).withColumn("event_time", F.current_timestamp())
    registry.append_events(accepted, registry_path(models_root))
    return registry.SWITCHED % version


def train_folder(
    spark: SparkSession,
    folder: str,
    models_root: str,
    scenes: dict[str, Scene] | None = None,
    schemas: Mapping[str, T.StructType | str] | None = None,
    **options,
) -> list[str]:
    """Train every configured scene that has a table in the folder; returns the scene ids.

    Types come from ``schemas`` by scene id where given, and are inferred otherwise. The
    driver loops over scenes, not over data; each scene's work is distributed.
    """
    scenes = scenes or load_scenes()
    found = discover_tables(spark, folder, scenes).orderBy("scene_id", "table_path").collect()
    for row in found:
        table = read_table(spark, row.table_path, schema=(schemas or {}).get(row.scene_id))
        train_scene(table, scenes[row.scene_id], models_root, dataset=row.table_path, **options)
    return [row.scene_id for row in found]
