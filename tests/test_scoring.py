"""Metrics, thresholds, calibration, model choice, previews."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from sceneforge.operators import metrics, scoring


def _pairs(spark, pairs):
    return spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, prediction double")


@pytest.mark.parametrize("classes", [2, 3, 5])
def test_f1_and_accuracy_equal_the_evaluator(spark, classes):
    draw = random.Random(classes)
    df = _pairs(spark, [(draw.randrange(classes), draw.randrange(classes + 1)) for _ in range(300)])
    got = metrics.accuracy_f1(metrics.confusion_counts(df)).first()
    for name, value in (("f1", got.f1), ("accuracy", got.accuracy)):
        assert value == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(df), abs=1e-12)


def test_report_of_a_class_never_predicted(spark):
    rows = {r["class"]: r for r in metrics.class_report(metrics.confusion_counts(_pairs(spark, [(0, 0), (1, 0)]))).collect()}
    assert (rows[1].precision, rows[1].recall, rows[1].f1, rows[1].support) == (0, 0, 0, 1)
    assert (rows[0].precision, rows[0].recall, rows[0].f1) == (0.5, 1.0, pytest.approx(2 / 3))


def test_dense_matrix_has_labels_and_predictions(spark):
    counts = metrics.confusion_counts(_pairs(spark, [(0, 0), (0, 7), (2, 0)]))
    got = {(r.true_pos, r.pred_pos): (r.label_name, r.prediction_name, r.cnt) for r in metrics.dense_confusion(counts, {0: "Zero"}).collect()}
    assert got == {
        (0, 0): ("Zero", "Zero", 1), (0, 1): ("Zero", "2", 0), (0, 2): ("Zero", "7", 1),
        (1, 0): ("2", "Zero", 1), (1, 1): ("2", "2", 0), (1, 2): ("2", "7", 0),
        (2, 0): ("7", "Zero", 0), (2, 1): ("7", "2", 0), (2, 2): ("7", "7", 0),
    }


def test_dense_matrix_of_nothing(spark):
    counts = metrics.confusion_counts(_pairs(spark, []))
    assert metrics.dense_confusion(counts).count() == 0
    assert metrics.accuracy_f1(counts).first().accuracy == 0.0


def test_dense_matrix_has_all_classes_on_both_sides(spark):
    df = spark.range(1500).select(F.col("id").alias("label"), ((F.col("id") * 7) % 1600 + 100).alias("prediction"))
    counts = metrics.confusion_counts(df)
    dense = metrics.dense_confusion(counts)
    classes = counts.select("label").union(counts.select("prediction")).distinct().count()
    assert dense.agg(F.count("*"), F.sum("cnt")).first() == (classes**2, 1500)


def test_binary_counts(spark):
    row = metrics.binary_counts(metrics.confusion_counts(_pairs(spark, [(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)]))).first()
    assert (row.tp, row.fp, row.fn, row.f1) == (2, 1, 1, pytest.approx(2 / 3))
    assert metrics.binary_counts(metrics.confusion_counts(_pairs(spark, [(0, 0)]))).first().f1 == 0.0


def test_unlabeled_rows_are_not_measured(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert metrics.accuracy_f1(metrics.confusion_counts(df)).first().n_rows == 1
    assert metrics.prediction_distribution(df).first().value == 2


def _scored(spark, rows):
    return spark.createDataFrame([(float(y), float(p)) for y, p in rows], "label double, p1 double").withColumn(
        "prediction", (F.col("p1") >= 0.5).cast("double")
    )


def test_sweep_by_brute_force(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(2), draw.choice([draw.random(), *scoring.THRESHOLDS])) for _ in range(400)]
    got = {r.threshold: r for r in scoring.threshold_sweep(_scored(spark, rows)).collect()}
    assert sorted(got) == list(scoring.THRESHOLDS)
    best = None
    for t in scoring.THRESHOLDS:
        tp = sum(y == 1 and p >= t for y, p in rows)
        fp = sum(y == 0 and p >= t for y, p in rows)
        fn = sum(y == 1 and p < t for y, p in rows)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0
        assert (got[t].tp, got[t].fp, got[t].fn) == (tp, fp, fn) and got[t].f1 == pytest.approx(f1)
        if best is None or f1 > best[1]:
            best = (t, f1)
    assert scoring.best_threshold(scoring.threshold_sweep(_scored(spark, rows))).first().threshold == best[0]


def test_best_threshold_ties_and_nothing_found(spark):
    tie = scoring.threshold_sweep(_scored(spark, [(1, 0.95), (0, 0.01)]))
    assert scoring.best_threshold(tie).first().threshold == 0.05
    none = scoring.threshold_sweep(_scored(spark, [(0, 0.3), (1, 0.01)]))
    assert scoring.best_threshold(none).first().threshold == 0.5


def test_threshold_counts_the_boundary_and_moves_confidence(spark):
    out = scoring.finish_binary(_scored(spark, [(1, 0.3), (1, 0.2999), (0, 0.9)]), 0.3, None, None)
    rows = sorted((r.p1, r.prediction, r.prediction_orig, round(r.confidence, 4)) for r in out.collect())
    assert rows == [(0.2999, 0.0, 0.0, 0.7001), (0.3, 1.0, 0.0, 0.3), (0.9, 1.0, 1.0, 0.9)]


def test_confidence_of_any_class_and_of_none(spark):
    df = spark.createDataFrame([(2.0, [0.1, 0.2, 0.7]), (0.0, [0.6, 0.3, 0.1])], "prediction double, p array<double>")
    got = df.select(scoring.confidence(F.col("prediction"), F.col("p")).alias("c")).collect()
    assert [r.c for r in got] == [0.7, 0.6]
    assert df.select(scoring.confidence(F.col("prediction"), None).alias("c")).first().c == 0.0


def test_calibration_is_the_penalized_logistic_fit(spark):
    draw = random.Random(11)
    xs = [draw.uniform(-3, 3) for _ in range(500)]
    ys = [float(draw.random() < 1 / (1 + math.exp(-(1.5 * x - 0.4)))) for x in xs]
    df = spark.createDataFrame(list(zip(xs, ys)), "raw1 double, label double")
    slope, intercept = scoring.fit_calibration(df)
    a = b = 0.0
    for _ in range(50):  # Newton steps on log loss + a²/2
        ga, gb, haa, hab, hbb = a, 0.0, 1.0, 0.0, 0.0
        for x, y in zip(xs, ys):
            p = 1 / (1 + math.exp(-(a * x + b)))
            w = p * (1 - p)
            ga, gb = ga + (p - y) * x, gb + p - y
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    assert (slope, intercept) == (pytest.approx(a, abs=1e-3), pytest.approx(b, abs=1e-3))


def test_no_calibration_from_one_class_or_no_rows(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.7, 1.0)], "raw1 double, label double")
    assert scoring.fit_calibration(df) is None
    assert scoring.fit_calibration(df.limit(0)) is None


def test_candidate_counts_equal_one_pass_each(spark):
    draw = random.Random(5)
    df = spark.createDataFrame(
        [(draw.choice([0, 1, None]), float(draw.randrange(2)), float(draw.randrange(2))) for _ in range(200)],
        "label int, a double, b double",
    )
    together = scoring.candidate_counts(df, {"a": F.col("a"), "b": F.col("b")})
    apart = [
        metrics.confusion_counts(df.withColumn("prediction", F.col(c))).withColumn("algo", F.lit(c)) for c in "ab"
    ]
    cols = ["algo", "label", "prediction", "cnt"]
    assert sorted(together.select(cols).collect()) == sorted(apart[0].union(apart[1]).select(cols).collect())
    many = scoring.candidate_counts(df, {"a": F.col("a"), "b": F.col("b")}, classes=100)
    assert sorted(many.select(cols).collect()) == sorted(together.select(cols).collect())
    whole = scoring.candidate_counts(df, {"a": F.col("a"), "b": F.col("b")}, unlabeled=True)
    assert whole.agg(F.sum("cnt")).first()[0] == 400


def test_best_model_ties_go_to_the_earlier_candidate(spark):
    rows = [("naive_bayes", 0.9), ("xgboost", 0.9), ("gbdt", 0.9), ("random_forest", 0.1)]
    df = spark.createDataFrame(rows, "algo string, f1 double")
    assert scoring.choose_best(df).first().algo == "gbdt"
    assert scoring.choose_default(df).first().algo == "random_forest"
    assert scoring.choose_default(df.filter("algo <> 'random_forest'")).first().algo == "gbdt"


def test_preview_shows_unlabeled_rows(spark):
    df = spark.createDataFrame([(i, float(i % 2), 0.123456) for i in range(150)], "k int, prediction double, confidence double")
    rows = scoring.preview(df, ["k"], {0: "No"}).collect()
    assert len(rows) == 100 and [r.id for r in rows] == list(range(1, 101))
    assert (rows[0].actual, rows[0].predicted, rows[0].confidence) == ("-", "No", 0.1235)
    labeled = scoring.preview(df.withColumn("label", F.lit(1.0)), ["k"], {0: "No"}, 3).collect()
    assert [r.actual for r in labeled] == ["1", "1", "1"]


def test_top_importances(spark):
    df = spark.createDataFrame([(f"f{i:02d}", float(i // 2)) for i in range(14)], "name string, value double")
    assert [r.name for r in scoring.top_importances(df, 3).collect()] == ["f12", "f13", "f10"]
