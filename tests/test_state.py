"""Registry, run log and amplification."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sceneforge.operators import amplify as amp, registry, runlog
from sceneforge.plans.enlarge import enlarge_table
from sceneforge.session import claim, release, scratch_path


def _registered(spark, rows):
    return registry.register_events(
        spark.createDataFrame(
            rows, "scene_id string, version int, algo string, seq long, accuracy double, f1_score double, train_size long"
        ).withColumns({"dataset": F.lit("d"), "rows": F.lit(1).cast("long")})
    )


def _activated(spark, events, rows):
    asked = spark.createDataFrame(rows, "scene_id string, version int, seq long")
    return events.unionByName(registry.activate_events(asked, events), allowMissingColumns=True)


def test_versions(spark):
    events = _registered(
        spark,
        [
            ("s", 1, "gbdt", 1, 0.5, 0.5, 10), ("s", 1, "gbdt", 2, 0.6, 0.6, 11), ("s", 2, "gbdt", 3, 0.7, 0.7, 12),
            ("s", 2, "naive_bayes", 4, 0.4, 0.4, 12), ("t", 4, "gbdt", 5, 0.1, 0.1, 9),
        ],
    )
    events = _activated(spark, events, [("s", 1, 10), ("s", 7, 11), ("u", 1, 12)])
    heads = {r.scene_id: (r.current_version, r.next_version, r.n_versions) for r in registry.version_heads(events).collect()}
    assert heads == {"s": (1, 3, 2), "t": (4, 5, 1)}
    where = {r.scene_id: r.models_subdir for r in registry.current_location(events).collect()}
    assert where == {"s": "", "t": "v4"}
    listed = {(r.scene_id, r.version): r for r in registry.list_versions(events).collect()}
    assert listed["s", 1].models["gbdt"].accuracy == 0.6 and listed["s", 1].is_current
    assert sorted(listed["s", 2].models) == ["gbdt", "naive_bayes"] and not listed["s", 2].is_current
    assert registry.next_version(events, "s") == 3 and registry.next_version(events, "nobody") == 1


def test_versions_tell_when_they_were_trained(spark):
    rows = [("s", 1, "gbdt", 1, "2024-01-02 03:04:05"), ("s", 1, "gbdt", 2, "2024-02-03 04:05:06"), ("s", 2, "gbdt", 2, None)]
    events = registry.register_events(spark.createDataFrame(rows, "scene_id string, version int, algo string, seq long, event_time string").withColumns({
        "event_time": F.col("event_time").cast("timestamp"), "dataset": F.lit("d"), "rows": F.lit(1).cast("long"), "accuracy": F.lit(0.5),
        "f1_score": F.lit(0.5), "train_size": F.lit(1).cast("long")}))
    listed = {r.version: r for r in registry.list_versions(events).collect()}
    assert listed[1].trained_at == "2024-02-03 04:05:06" and listed[2].trained_at is None
    assert listed[2].is_current and not listed[1].is_current  # of one time: the newest version
    first = events.filter("version = 1")
    grid = {r.algo: r.trained_at for r in registry.status_grid(spark.createDataFrame([("s",)], "scene_id string"), first).collect()}
    assert grid["gbdt"] == "2024-02-03 04:05:06" and grid["xgboost"] is None


def test_a_version_is_claimed_once(spark):
    path = scratch_path(spark, "claims") + "/s/v1"
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: claim(spark, path), range(24))) == 1
    release(spark, path)
    assert claim(spark, path) and not claim(spark, path)


def test_appends_at_one_time_are_all_kept(spark):
    path = scratch_path(spark, "registry")
    rows = [[("s", k, "gbdt", k, 0.5, 0.5, 10)] for k in range(1, 9)]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda r: registry.append_events(_registered(spark, r), path), rows))
    stored = registry.read_events(spark, path)
    assert stored.columns[-1] != "batch" and sorted(r.version for r in stored.collect()) == list(range(1, 9))
    plan = stored.filter("scene_id = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scene_id" in plan


def test_status_grid(spark):
    events = _registered(spark, [("s", 2, "gbdt", 1, 0.5, 0.5, 10)])
    scenes = spark.createDataFrame([("s",), ("new",)], "scene_id string")
    grid = {(r.scene_id, r.algo): r for r in registry.status_grid(scenes, events).collect()}
    assert len(grid) == 8
    assert grid["s", "gbdt"].trained and grid["s", "gbdt"].current_version == 2
    assert not grid["s", "xgboost"].trained and grid["new", "gbdt"].current_version == 1
    assert grid["new", "gbdt"].training == "idle"


def test_stored_events_keep_all_columns(spark):
    path = scratch_path(spark, "registry")
    registry.append_events(_registered(spark, [("s", 1, "gbdt", 1, 0.5, 0.5, 10)]), path)
    registry.append_events(_registered(spark, [("s", 2, "gbdt", 2, 0.5, 0.5, 10)]), path)
    stored = registry.read_events(spark, path)
    assert stored.count() == 2 and stored.first().threshold is None


def test_log_of_one_run(spark):
    asked = spark.createDataFrame(
        [(1, 1, "  ", "f.csv", "auto"), (2, 2, "s", "g.csv", "gbdt")],
        "task_id long, seq long, scene_type string, file_path string, model_type string",
    ).withColumn("predict_time", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    log = runlog.open_rows(asked)
    step = spark.createDataFrame([(1, 3, "gbdt")], "task_id long, seq long, current_model string")
    log = log.unionByName(runlog.progress_rows(step), allowMissingColumns=True)
    state = {r.task_id: r for r in runlog.latest_state(log).collect()}
    assert (state[1].scene_type, state[1].status, state[1].current_model) == ("unknown", "processing", "gbdt")
    assert state[1].model_progress_status == "Task queued..." and state[2].current_model == "None"
    done = spark.createDataFrame(
        [(1, 4, 0.5, "completed", '{"accuracy": 0.5}')],
        "task_id long, seq long, accuracy double, status string, result_json string",
    ).withColumn("finish_time", F.lit("2024-01-02 03:04:06").cast("timestamp"))
    log = log.unionByName(runlog.close_rows(done), allowMissingColumns=True)
    row = runlog.task_status(log, 1, "accuracy double").first()
    assert (row.status, row.model_progress_status, row.current_model, row.result.accuracy) == ("completed", "Complete", "None", 0.5)
    assert "result_json" not in row.asDict()
    assert runlog.task_status(log, 99).count() == 0
    assert [r.task_id for r in runlog.history(log).collect()] == [2, 1]
    assert [r.task_id for r in runlog.history(log, "s").collect()] == [2]
    assert log.select(runlog.time_text(F.col("predict_time")).alias("t")).first().t == "2024-01-02 03:04:05"


@pytest.mark.parametrize("copies", [1, 3, 64, 65, 200])
def test_replicas(spark, copies):
    got = amp.replicate(spark.range(4), copies).groupBy("id").agg(F.collect_set("replica").alias("r")).collect()
    assert len(got) == 4 and all(sorted(r.r) == list(range(copies)) for r in got)


def test_many_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(amp, "ROWS_PER_TASK", 100)
    many = amp.replicate(spark.range(4).coalesce(1), 200)
    assert many.count() == 800
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(8)" in plan


def test_amplified_table(spark):
    rows = [(i, f"n{i}", 100.0 + i, i % 3, i % 2, 50.0 + i) for i in range(40)]
    df = spark.createDataFrame(rows, ["user_id", "name_id", "price", "code", "label_x", "humidity"])
    out = amp.amplify(df, 3, ["user_id"], keep_replica=True)
    assert out.count() == 120 and out.columns == [*df.columns, "replica"]
    seen = {(r.replica, r.user_id): r for r in out.collect()}
    for i in range(40):
        for k in range(3):
            r = seen[k, i + 40 * (k + 1)]
            assert r.name_id == f"n{i}_{k}" and r.code == i % 3 and r.label_x == i % 2
            assert 0.99 <= r.price / (100 + i) <= 1.01 and 0.99 <= r.humidity / (50 + i) <= 1.01
            assert r.price != 100.0 + i
    again = amp.amplify(df.repartition(5), 3, ["user_id"], keep_replica=True)
    assert sorted(again.collect()) == sorted(out.collect())


def test_random_noise_stays_in_range(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") + 1000.0).alias("price"))
    out = amp.amplify(df, 2, ["id"], seed=7)
    assert out.filter("price < 0.99 * 1000 OR price > 1.01 * 1099").count() == 0


def test_code_columns_at_the_limit(spark):
    df = spark.range(1000).select(
        (F.col("id") % 9).alias("nine"), (F.col("id") % 10).alias("ten"), F.col("id").alias("many")
    )
    assert amp.code_columns(df, ["nine", "ten", "many"]) == ["nine"]
    assert amp.code_columns(df, []) == []


def test_copies_for_a_size(spark):
    assert amp.replicas_for(100, 1000) == 11 and amp.replicas_for(1 << 31) == 1


def test_enlarged_csv(spark):
    seed, large = scratch_path(spark, "seed") + ".csv", scratch_path(spark, "large") + ".csv"
    spark.range(50).withColumn("x", F.col("id") * 2.5).coalesce(1).write.option("header", True).csv(seed)
    size = amp.stored_bytes(spark, seed)
    copies = enlarge_table(spark, seed, large, ["id"], target_bytes=size * 4)
    assert copies == 5
    assert spark.read.option("header", True).csv(large).count() == 250
    assert amp.stored_bytes(spark, large) >= size * 4


def test_one_scene_and_one_run_with_most_rows(spark):
    """A group with a third of all rows and more is reduced before the shuffle; results stay whole."""
    n = F.col("id")
    owner = F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (n % 50).cast("string")))
    events = registry.register_events(
        spark.range(30_000).select(
            owner.alias("scene_id"), (1 + n % 4).cast("int").alias("version"), F.lit("gbdt").alias("algo"),
            n.alias("seq"), F.lit("d").alias("dataset"), n.alias("rows"),
            (n / 1e6).alias("accuracy"), (n / 1e6).alias("f1_score"), n.alias("train_size"),
        )
    )
    hot = registry.version_heads(events).filter("scene_id = 'hot'").first()
    assert (hot.current_version, hot.n_versions) == (1 + 29_997 % 4, 4)
    latest = registry.latest_models(events).filter("scene_id = 'hot'").collect()
    assert sorted(r.seq for r in latest) == [29_988, 29_991, 29_994, 29_997]
    log = spark.range(30_000).select(
        F.when(n % 3 == 0, 0).otherwise(n).cast("long").alias("task_id"), n.alias("seq"),
        F.when(n % 2 == 0, F.concat(F.lit("v"), n.cast("string"))).alias("status"),
    )
    states = runlog.latest_state(log)
    assert states.count() == 20_001
    assert states.filter("task_id = 0").first().status == "v29994"
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
