"""Regularised boosting against a plain version, and as a stage of saved pipelines."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sceneforge.operators import boosting, learners
from sceneforge.operators.boosting import RegularizedBoosting, Settings


def plain_boosting(bins, label, classes, s):
    """Margins after all rounds, node by node with explicit loops; all rows and features."""
    width = 1 if classes <= 2 else classes
    margins = np.zeros((len(bins), width))

    def soft(x):
        return np.sign(x) * max(abs(x) - s.l1, 0.0)

    def grow(rows, g, h, depth):
        weight = np.full(len(rows), -s.rate * soft(g[rows].sum()) / (h[rows].sum() + s.l2))
        if depth == s.depth:
            return weight
        score = lambda r: soft(g[r].sum()) ** 2 / (h[r].sum() + s.l2)
        best = (boosting.LEAST_GAIN, None)
        for f in range(bins.shape[1]):
            for b in range(bins[:, f].max()):
                left = bins[rows, f] <= b
                sides = rows[left], rows[~left]
                if min(h[r].sum() for r in sides) < 1:
                    continue
                gain = 0.5 * (sum(map(score, sides)) - score(rows))
                if gain > best[0] + 1e-12:
                    best = (gain, left)
        if best[1] is not None:
            weight[best[1]] = grow(rows[best[1]], g, h, depth + 1)
            weight[~best[1]] = grow(rows[~best[1]], g, h, depth + 1)
        return weight

    for _ in range(s.rounds):
        if width == 1:
            p = 1 / (1 + np.exp(-margins))
            g, h = p - (label == 1)[:, None], p * (1 - p)
        else:
            p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
            g, h = p - np.eye(classes)[label], 2 * p * (1 - p)
        margins = margins + np.stack([grow(np.arange(len(bins)), g[:, k], h[:, k], 0) for k in range(width)], axis=1)
    return margins


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 9, 240), rng.integers(0, 5, 240), rng.normal(size=240).round(1)])
    label = ((x[:, 0] > 4).astype(int) + (x[:, 2] > 0.3) * (x[:, 1] > 1)).astype(int)
    label = np.where(rng.random(240) < 0.1, rng.integers(0, 3, 240), label)
    rows = [(k, *map(float, r), float(c)) for k, (r, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label double").repartition(3)
    return x, label, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def margins_of(model, df, classes):
    raw = df.transform(model.transform).orderBy("id").select(vector_to_array(model.getRawPredictionCol()).alias("r")).collect()
    raw = np.array([r.r for r in raw])
    return raw[:, 1:] * 2 if classes == 2 else raw


@pytest.mark.parametrize("classes, task_bytes", [(2, 8 << 20), (3, 8 << 20), (3, 2000)])
def test_margins_equal_plain_version(points, classes, task_bytes, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_BYTES", task_bytes)  # one task, or several with a shuffle
    x, label, df = points
    label = np.minimum(label, classes - 1)
    df = df.withColumn("label", F.least(F.col("label"), F.lit(float(classes - 1))))
    settings = {"rounds": 6, "depth": 3, "rows": 1.0, "columns": 1.0}
    model = RegularizedBoosting(classes=classes, settings=json.dumps(settings)).fit(df)
    cuts = boosting.quantile_cuts(df.select(vector_to_array("features").alias("x")), 3, 128)
    bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    expected = plain_boosting(bins, label, classes, Settings(**settings))
    assert np.abs(margins_of(model, df, classes) - expected).max() < 1e-9


def test_sampling_is_the_same_on_each_run_and_near_its_share():
    row = np.arange(20_000)
    drawn = boosting.sampled(row, 3, 0.8, 42)
    assert abs(drawn.mean() - 0.8) < 0.02 and (drawn == boosting.sampled(row, 3, 0.8, 42)).all()
    assert (drawn != boosting.sampled(row, 4, 0.8, 42)).mean() > 0.2 and boosting.sampled(row, 1, 1.0, 1).all()
    assert [len(f) for f in boosting.chosen_features(10, 0, 3, Settings())] == [8, 8, 8]


def test_l1_and_l2_shrink_leaves():
    strict, loose = Settings(l1=5, l2=10), Settings(l1=0, l2=0)
    assert boosting.leaf_value(4, 8, strict) == 0 and boosting.leaf_value(4, 8, loose) == pytest.approx(-0.05)
    assert boosting.leaf_value(-7, 8, strict) == pytest.approx(0.1 * 2 / 18)


def test_rows_are_kept_in_blocks(spark):
    df = spark.range(3000).coalesce(1).select(F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 2).cast("int").alias("label"), F.col("id").alias("row"))
    cuts = [np.array([10.0, 20.0]), np.array([3.0])]
    state = df.mapInArrow(boosting._binned(cuts, 3), boosting._STATE)
    grown = state.mapInArrow(boosting._add_trees(2, [boosting.Tree(2) for _ in range(3)]), boosting._STATE)
    for blocks in (state.toArrow(), grown.toArrow()):
        assert blocks.num_rows == 1  # of 10,000 rows at most
        ((row, label, bins, margins),) = boosting._blocks(blocks.to_batches(), 2, 3)
        assert row.tolist() == list(range(3000)) and label.tolist() == [k % 2 for k in range(3000)]
        assert bins.tolist() == [[(k > 10) + (k > 20) for k in range(3000)], [int(k % 7 > 3) for k in range(3000)]]
        assert margins.shape == (3000, 3) and not margins.any()


def test_rows_go_down_a_tree_by_its_cuts():
    tree, values = boosting.Tree(3), np.random.default_rng(1).integers(0, 9, (2, 500))
    for node, (feature, cut) in {0: (0, 4), 2: (1, 2), 5: (0, 6)}.items():
        tree.feature[node], tree.cut[node] = feature, cut
    a, b = values
    expected = np.where(a <= 4, 1, np.where(b > 2, 6, np.where(a > 6, 12, 11)))
    assert (tree.descend(values, tree.cut) == expected).all() and tree.descend(values[:, :0], tree.cut).size == 0


def test_saved_and_loaded_in_a_pipeline(points, spark, tmp_path):
    _, label, df = points
    model = learners.classifier("xgboost", 3, rounds=25).fit(df)
    assert model.numRounds == 25 and float(sum(model.featureImportances)) == pytest.approx(1)
    named = learners.with_output_names(model, "xgboost")
    PipelineModel([named]).write().overwrite().save(f"{tmp_path}/m")
    scored = PipelineModel.load(f"{tmp_path}/m").transform(df).orderBy("id").collect()
    assert [r["xgboost:prediction"] for r in scored] == [r["xgboost:prediction"] for r in named.transform(df).orderBy("id").collect()]
    assert all(abs(sum(r["xgboost:probability"]) - 1) < 1e-12 for r in scored)
    assert all(r["xgboost:prediction"] == np.argmax(r["xgboost:probability"]) for r in scored)
    assert np.mean([r["xgboost:prediction"] == c for r, c in zip(scored, label)]) > 0.85
    assert named.transform(df.limit(0)).collect() == []


def test_one_class_and_constant_features_give_no_splits(points):
    _, _, df = points
    model = RegularizedBoosting(classes=2, settings='{"rounds": 2}').fit(df.withColumn("label", F.lit(0.0)))
    assert all(r.prediction == 0 for r in model.transform(df).collect())
    with pytest.raises(ValueError):
        RegularizedBoosting().fit(df.limit(0))
