from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sceneforge.scenes import (
    SCENE_SCHEMA, Scene, attach_scene, column_table, delete_scenes, dump_scenes, label_table, load_scenes, scene_table,
    upsert_scenes, with_scene, without_scene,
)
from sceneforge.session import scratch_path, shared_dir
from sceneforge.sources import results, tables


def test_built_in_scenes():
    scenes = load_scenes()
    sizes = {sid: len(s.required) for sid, s in scenes.items()}
    assert sizes == {
        "shop_shipping": 11, "shop_churn": 19, "shop_fraud": 30, "shop_order": 24, "trans_satisfaction": 23,
        "trans_delay": 14, "trans_accident": 38, "ind_failure": 7, "ind_quality": 0,
    }
    for scene in scenes.values():
        assert not scene.required or scene.target in scene.required
    assert scenes["shop_fraud"].required[0] == "V1" and scenes["shop_fraud"].required[27] == "V28"
    assert len(scenes["ind_quality"].ignored) == 11
    assert scenes["ind_quality"].oversample_cap == 50 and scenes["shop_churn"].oversample_cap == 10
    assert scenes["trans_accident"].labels == {"2": "Level 2", "3": "Level 3"}


def test_scene_text_with_text_labels():
    text = "scenes: {s: {target: satisfaction, labels: {satisfied: Happy, '0': No}, columns: [a, b, satisfaction]}}"
    scene = load_scenes(text)["s"]
    assert scene.labels == {"satisfied": "Happy", "0": "No"}
    assert scene.required == ("a", "b", "satisfaction") and scene.category == "Unclassified"
    assert scene.description == "Predict satisfaction"


def test_scene_file_round_trip():
    scenes = with_scene(load_scenes(), Scene("mine", "No", ("a/b", "c [x]", "No"), {"1.0": "Yes"}, name="mine"))
    assert load_scenes(dump_scenes(scenes))["mine"].labels == {"1.0": "Yes"}
    again = load_scenes(dump_scenes(scenes))
    for sid, scene in scenes.items():
        assert (again[sid].target, again[sid].required, again[sid].labels) == (scene.target, scene.required, scene.labels)
        assert (again[sid].ignored, again[sid].oversample_cap) == (scene.ignored, scene.oversample_cap)
        assert (again[sid].hook is None) == (scene.hook is None)


def test_add_and_remove():
    scenes = with_scene(load_scenes(), Scene("mine", "t"))
    assert "mine" in scenes and "mine" not in without_scene(scenes, "mine")
    with pytest.raises(KeyError):
        without_scene(scenes, "absent")


def test_scene_tables(spark):
    scenes = load_scenes()
    assert scene_table(spark, scenes).count() == 9
    assert column_table(spark, scenes).count() == 166
    assert label_table(spark, scenes).count() == 18
    changes = spark.createDataFrame([("shop_churn", "n", "c", "d", "x", 5)], SCENE_SCHEMA + ", seq long")
    edited = upsert_scenes(scene_table(spark, scenes), changes)
    assert edited.count() == 9
    assert edited.filter("scene_id = 'shop_churn'").first().target_col == "x"
    gone = spark.createDataFrame([("shop_churn",)], "scene_id string")
    assert delete_scenes(edited, gone).count() == 8


def test_unknown_scene_gets_empty_target(spark):
    dim = scene_table(spark, load_scenes())
    df = spark.createDataFrame([("shop_churn",), ("none",), (None,)], "scene_id string")
    for bound in (9, 10**9):
        got = {r.scene_id: r.target_col for r in attach_scene(df, dim, bound).collect()}
        assert got == {"shop_churn": "Churn", "none": "", None: ""}


@pytest.mark.parametrize(
    "path, scene",
    [
        ("file:/d/shop_churn_clean.csv/part-0.csv", "shop_churn"),
        ("/d/shop_churn.csv", "shop_churn"),
        ("/d/x.parquet/part-0.snappy.parquet", "x"),
        ("/d/shop_churn_clean.parquet", "shop_churn"),
        ("/d/readme.txt", ""),
    ],
)
def test_scene_of_path(spark, path, scene):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(tables.scene_of_path(F.col("p")).alias("s")).first().s == scene


def test_discovery_finds_files_and_folders(spark):
    folder = scratch_path(spark, "found")
    spark.range(3).write.option("header", True).csv(f"{folder}/shop_churn_clean.csv")
    spark.range(3).write.parquet(f"{folder}/trans_delay.parquet")
    spark.range(3).write.parquet(f"{folder}/other.parquet")
    got = {r.scene_id: r for r in tables.discover_tables(spark, folder, load_scenes()).collect()}
    assert sorted(got) == ["shop_churn", "trans_delay"]
    assert got["shop_churn"].table_path.endswith("/shop_churn_clean.csv") and got["shop_churn"].bytes > 0
    assert tables.read_table(spark, got["trans_delay"].table_path).count() == 3


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", fmt="xml")


def test_results_round_trip(spark):
    text = spark.createDataFrame(
        [('{"accuracy":0.5,"final_model":"gbdt","distribution":[{"name":"A","value":3}]}',), ("{oops",), ("",), (None,)],
        "t string",
    )
    rows = text.select(results.decode(F.col("t")).alias("r")).collect()
    assert rows[0].r.accuracy == 0.5 and rows[0].r.distribution[0].value == 3
    assert [r.r for r in rows[1:]] == [None, None, None]
    path = scratch_path(spark, "results")
    results.append_results(text.limit(1).select(F.lit("s").alias("scene_id"), F.col("t").alias("result_json")), path)
    assert results.read_results(spark, path).first().result.final_model == "gbdt"


class _Session:
    """Just the settings and the master of a session."""

    def __init__(self, master, **settings):
        self.settings = {k.replace("__", "."): v for k, v in settings.items()}
        self.conf = self
        self.sparkContext = type("Context", (), {"master": master})

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def set(self, name, value):
        self.settings[name] = value


def test_shared_folder_is_the_one_the_cluster_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")
    assert shared_dir(_Session("spark://host", spark__checkpoint__dir="s3://bucket/x/")) == "s3://bucket/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://host"))
    local = _Session("local[2]")
    assert shared_dir(local) == shared_dir(local)
    assert scratch_path(local, "a") != scratch_path(local, "a")
