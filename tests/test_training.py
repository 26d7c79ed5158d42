"""Training and scoring whole tables on separable data."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sceneforge.operators import registry, runlog
from sceneforge.plans.score import Scorer, run_logged, score_table
from sceneforge.plans.train import activate, claim_version, known_events, registry_path, train_folder, train_scene
from sceneforge.scenes import Scene
from sceneforge.session import scratch_path
from sceneforge.sources.results import read_results
from sceneforge.streaming.landing import score_landing, watch

SCENE = Scene("bought", "bought", labels={"1": "Yes", "0": "No"})


def _table(spark, rows=600, classes=2):
    """Class 1 (or the middle one) is the majority, so class index and raw value differ."""
    n = F.col("id")
    cut = (n % 100 / 100.0).alias("score")
    raw = F.when(n % 100 >= 30, 1).otherwise(0)
    if classes == 3:
        raw = F.when(n % 100 >= 60, "high").when(n % 100 >= 25, "mid").otherwise("low")
    return spark.range(rows).select(
        n.alias("row id"),
        cut,
        F.concat(F.lit("g"), (n % 5).cast("string")).alias("group"),
        (n % 3 == 0).alias("odd.flag"),
        F.timestamp_seconds(1_700_000_000 + n * 3600).alias("seen at"),
        raw.alias("bought"),
    )


@pytest.fixture(scope="module")
def trained(spark):
    root = scratch_path(spark, "models")
    events = train_scene(_table(spark), SCENE, root, key=["row_id"], algos=["random_forest", "naive_bayes"])
    return root, events


def test_registry_rows(spark, trained):
    root, events = trained
    rows = {r.algo: r for r in registry.latest_models(known_events(spark, root)).collect()}
    assert sorted(rows) == ["naive_bayes", "random_forest"]
    forest = rows["random_forest"]
    assert (forest.version, forest.rows, forest.num_classes, forest.models_subdir) == (1, 600, 2, "")
    assert forest.class_values == ["1", "0"]
    assert forest.f1_score > 0.95 and forest.tuned_f1 > 0.95 and 0.05 <= forest.threshold <= 0.9
    assert forest.slope > 0
    assert {f["name"] for f in forest.features} >= {"score", "group", "odd_flag", "seen_at_hour"}
    assert max(forest.features, key=lambda f: f["value"])["name"] == "score"


def test_saved_model_is_one_whole_chain(spark, trained):
    root, _ = trained
    path = registry.latest_models(known_events(spark, root)).filter("algo = 'random_forest'").first().model_path
    assert len(PipelineModel.load(path).stages) == 4


def test_scores(spark, trained):
    root, _ = trained
    scorer = Scorer(spark, SCENE, root, ["row_id"])
    scored = score_table(_table(spark), scorer)
    assert scored.model == "random_forest" and scored.f1 > 0.95
    rows = scored.rows.collect()
    assert len(rows) == 600
    assert all(0 <= r.confidence <= 1 for r in rows)
    names = {r.predicted for r in rows}
    assert names == {"Yes", "No"}
    right = sum((r.predicted == "Yes") == (r.bought == 1) for r in rows) / 600
    assert right == pytest.approx(scored.accuracy) and right > 0.95
    result = scored.result()
    assert sum(d["value"] for d in result["distribution"]) == 600
    assert sum(c["cnt"] for c in result["confusion_matrix"]) == 600
    assert result["all_labels_indices"] == ["Yes", "No"]
    assert len(result["chart_data"]) == 100 and result["feature_importance"][0]["name"] == "score"
    assert {r["name"] for r in result["classification_report"]} == {"Yes", "No"}


def test_scoring_again_gives_the_same(spark, trained):
    root, _ = trained
    one = score_table(_table(spark), Scorer(spark, SCENE, root, ["row_id"]), "random_forest").rows
    two = score_table(_table(spark).repartition(3), Scorer(spark, SCENE, root, ["row_id"]), "random_forest").rows
    pick = ["row_id", "prediction", "confidence"]
    assert sorted(one.select(pick).collect()) == sorted(two.select(pick).collect())


def test_preview_is_the_first_of_all_rows(spark, trained):
    root, _ = trained
    scored = score_table(_table(spark), Scorer(spark, SCENE, root, ["row_id"]), "random_forest")
    whole = scored.rows.orderBy("row_key").limit(100).collect()
    shown = scored.preview().orderBy("id").collect()
    assert [r.predicted for r in shown] == [r.predicted for r in whole]


def test_unlabeled_table(spark, trained):
    root, _ = trained
    scored = score_table(_table(spark).drop("bought"), Scorer(spark, SCENE, root, ["row_id"]))
    assert scored.model == "random_forest" and scored.accuracy is None
    assert scored.rows.count() == 600 and "label" not in scored.rows.columns
    result = scored.result()
    assert result["confusion_matrix"] == [] and result["chart_data"][0]["actual"] == "-"


def test_new_categories_and_nulls_are_scored(spark, trained):
    root, _ = trained
    df = _table(spark).withColumn("group", F.when(F.col("score") > 0.5, "new")).withColumn(
        "score", F.when(F.col("row id") % 10 != 0, -F.col("score"))
    )
    for model in ("random_forest", "naive_bayes"):
        assert score_table(df, Scorer(spark, SCENE, root, ["row_id"]), model).rows.count() == 600


def test_missing_model(spark, trained):
    root, _ = trained
    with pytest.raises(RuntimeError, match="all models failed: gbdt: no gbdt model in version 1"):
        score_table(_table(spark), Scorer(spark, SCENE, root, ["row_id"]), "gbdt")
    with pytest.raises(ValueError, match="no trained model"):
        Scorer(spark, Scene("other", "t"), root)


def test_stream_equals_batch(spark, trained):
    root, _ = trained
    scorer = Scorer(spark, SCENE, root, ["row_id"])
    model = scorer.load("random_forest")
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "scored")
    state = scratch_path(spark, "state")
    _table(spark).repartition(3).write.parquet(landing)

    def run():
        landed = watch(spark, landing, _table(spark).schema)
        score_landing(landed, lambda df: scorer.final_rows(df, model), out, state).awaitTermination()

    run()
    pick = ["row_id", "prediction", "confidence", "label"]
    batch = scorer.final_rows(_table(spark), model).select(pick)
    assert sorted(spark.read.parquet(out).select(pick).collect()) == sorted(batch.collect())
    run()
    assert spark.read.parquet(out).count() == 600
    _table(spark, 700).filter("`row id` >= 600").write.mode("append").parquet(landing)
    run()
    assert spark.read.parquet(out).count() == 700


def test_logged_run(spark, trained):
    root, _ = trained
    path = scratch_path(spark, "input") + ".parquet"
    tidy = _table(spark).toDF("row_id", "score", "group", "odd_flag", "seen_at", "bought")
    tidy.write.parquet(path)
    log, results, out = (scratch_path(spark, n) for n in ("log", "results", "out"))
    assert run_logged(spark, path, SCENE, root, log, results, 1, key=["row_id"], out=out) == "completed"
    assert run_logged(spark, path, Scene("other", "t"), root, log, results, 2) == "failed"
    rows = runlog.history(runlog.read_log(spark, log)).collect()
    assert [(r.task_id, r.status) for r in rows] == [(2, "failed"), (1, "completed")]
    state = runlog.task_status(runlog.read_log(spark, log), 1).first()
    assert state.accuracy > 0.95 and state.model_progress_status == "Complete" and state.current_model == "None"
    assert state.result.final_model == "random_forest" and len(state.result.chart_data) == 100
    assert state.finish_time >= state.predict_time
    assert read_results(spark, results).filter("scene_id = 'bought'").first().result.accuracy == state.accuracy
    assert spark.read.parquet(out).count() == 600


def test_versions_and_activation(spark):
    root = scratch_path(spark, "versions")
    df = _table(spark, 300)
    for _ in range(2):
        train_scene(df, SCENE, root, key=["row_id"], algos=["naive_bayes"])
    assert Scorer(spark, SCENE, root, ["row_id"]).version == 2
    assert activate(spark, root, "bought", 1) == "Switched to v1"
    assert Scorer(spark, SCENE, root, ["row_id"]).folder == root
    with pytest.raises(ValueError, match="Version 9 not found"):
        activate(spark, root, "bought", 9)
    events = registry.read_events(spark, registry_path(root))
    rows = {r.version: r for r in registry.list_versions(events).collect()}
    assert rows[1].is_current and not rows[2].is_current and rows[2].models_subdir == "v2"
    assert rows[1].models["naive_bayes"].train_size == 300
    train_scene(df, SCENE, root, key=["row_id"], algos=["naive_bayes"])
    assert Scorer(spark, SCENE, root, ["row_id"]).version == 3


def test_trainings_at_one_time_get_two_versions(spark):
    root = scratch_path(spark, "race")
    df = _table(spark, 300)
    train = lambda _: train_scene(df, SCENE, root, key=["row_id"], algos=["naive_bayes"])
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(train, range(2)))
    events = registry.read_events(spark, registry_path(root))
    assert {r.version: r.rows for r in registry.list_versions(events).collect()} == {1: 300, 2: 300}
    for row in registry.latest_models(events).collect():
        assert PipelineModel.load(row.model_path).stages and row.trained_at is not None
    with pytest.raises(ValueError, match="1 classes"):
        train_scene(df.withColumn("bought", F.lit(1)), SCENE, root, key=["row_id"])
    assert claim_version(spark, root, "bought") == 3 and claim_version(spark, root, "bought") == 4


def test_three_classes_with_all_algorithms(spark):
    root = scratch_path(spark, "three")
    scene = Scene("level", "bought", labels={"mid": "Middle"})
    df = _table(spark, 300, classes=3)
    train_scene(df, scene, root, key=["row_id"], rounds=3)
    scorer = Scorer(spark, scene, root, ["row_id"])
    assert sorted(scorer.entries) == ["naive_bayes", "random_forest", "xgboost"]
    assert all(e.threshold is None and e.slope is None for e in scorer.entries.values())
    scored = score_table(df, scorer)
    assert scored.f1 > 0.9
    assert {r.predicted for r in scored.rows.select("predicted").distinct().collect()} == {"high", "Middle", "low"}
    boosted = score_table(df, scorer, "xgboost").rows
    assert boosted.filter("confidence > 1 / 3 AND confidence <= 1").count() == 300


def test_wide_categories_train_and_score(spark):
    root = scratch_path(spark, "wide")
    df = _table(spark, 300).withColumn("code", F.concat(F.lit("c"), (F.col("row id") % 97).cast("string")))
    train_scene(df, SCENE, root, key=["row_id"], algos=["random_forest"], max_categories=20)
    scorer = Scorer(spark, SCENE, root, ["row_id"])
    assert scorer.some_entry.wide_columns == ["code"] and "code" in scorer.some_entry.slots
    assert score_table(df.withColumn("code", F.lit("unseen")), scorer).rows.count() == 300


def test_one_class_is_refused(spark):
    df = _table(spark, 100).withColumn("bought", F.lit(1))
    with pytest.raises(ValueError, match="1 classes"):
        train_scene(df, SCENE, scratch_path(spark, "one"))


def test_folder_of_scenes(spark):
    folder, root = scratch_path(spark, "folder"), scratch_path(spark, "all")
    _table(spark, 200).drop("seen at").write.option("header", True).csv(f"{folder}/bought_clean.csv")
    _table(spark, 200).write.option("header", True).csv(f"{folder}/stranger.csv")
    assert train_folder(spark, folder, root, {"bought": SCENE}, algos=["naive_bayes"], key=["row_id"]) == ["bought"]
    assert Scorer(spark, SCENE, root, ["row_id"]).version == 1


def test_folder_and_run_take_a_schema(spark):
    folder, root, log = scratch_path(spark, "typed"), scratch_path(spark, "typed-models"), scratch_path(spark, "typed-log")
    df = _table(spark, 200).drop("seen at").withColumn("bought", F.when(F.col("bought") == 1, "01").otherwise("02"))
    df.write.option("header", True).csv(f"{folder}/bought.csv")
    scene = Scene("bought", "bought")
    for schemas, classes in (({"bought": df.schema}, ["01", "02"]), (None, ["1", "2"])):
        train_folder(spark, folder, root, {"bought": scene}, schemas, algos=["naive_bayes"], key=["row_id"])
        assert sorted(Scorer(spark, scene, root, ["row_id"]).some_entry.class_values) == classes
    assert activate(spark, root, "bought", 1) == "Switched to v1"
    results, out = scratch_path(spark, "typed-results"), scratch_path(spark, "typed-out")
    assert run_logged(spark, f"{folder}/bought.csv", scene, root, log, results, 1, "naive_bayes", ["row_id"], out, df.schema) == "completed"
    assert {r.bought for r in spark.read.parquet(out).select("bought").distinct().collect()} == {"01", "02"}


def test_scoring_scans_and_scores_the_input_once(spark):
    root = scratch_path(spark, "once")
    df = _table(spark, 300)
    train_scene(df, SCENE, root, key=["row_id"], algos=["naive_bayes", "random_forest"])
    path = scratch_path(spark, "once-input")
    df.write.parquet(path)
    scored = score_table(spark.read.parquet(path), Scorer(spark, SCENE, root, ["row_id"]))
    for result in (scored.rows, scored.counts, scored.preview(), scored.confusion(), scored.distribution()):
        assert path not in result._jdf.queryExecution().executedPlan().toString()
        assert "scored-" in str(result.inputFiles()) or "counts-" in str(result.inputFiles())
    assert scored.rows.count() == 300 and scored.preview().count() == 100
