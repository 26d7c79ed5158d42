"""Confidence, calibration, thresholds and model choice on scored tables.

A scored table has ``prediction`` and, when the model gives them, ``p1`` (the
probability of class 1) and ``raw1`` (the raw score of class 1).  The operators
do not care which model, learned or fixed, produced them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneforge.functions import class_name, or_zero, sigmoid

# The decision thresholds tried.
THRESHOLDS = (
    0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45,
    0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90,
)
DEFAULT_THRESHOLD = 0.5

# Candidates of the automatic choice; ties go to the earlier one.
CANDIDATES = ("random_forest", "gbdt", "xgboost", "naive_bayes")
DEFAULT_CANDIDATE = "random_forest"

PREVIEW_ROWS = 100

# Groups up to which candidates are counted together.
JOINT_GROUPS = 10_000


# --- confidence ------------------------------------------------------------------------


def confidence(prediction: Column, probability: Column | None) -> Column:
    """Probability of the predicted class, whichever it is; 0.0 from models without one."""
    if probability is None:
        return F.lit(0.0)
    return F.element_at(probability, prediction.cast("int") + 1)


def apply_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    """Predict class 1 from the threshold on; the model's own choice is kept."""
    decided = F.when(F.col("p1") >= F.lit(threshold), 1.0).otherwise(0.0)
    return scored.withColumns({"prediction_orig": F.col("prediction"), "prediction": decided})


def calibrated(raw1: Column, slope: float, intercept: float) -> Column:
    """Calibrated probability of class 1 from its raw score."""
    return sigmoid(F.lit(slope) * raw1 + F.lit(intercept))


def calibrated_confidence(prediction: Column, raw1: Column, slope: float, intercept: float) -> Column:
    c = calibrated(raw1, slope, intercept)
    return F.when(prediction == 1.0, c).otherwise(1.0 - c)


def finish_binary(
    scored: DataFrame, threshold: float | None, slope: float | None, intercept: float | None
) -> DataFrame:
    """Threshold first, then the confidence of the final prediction."""
    if threshold is not None and "p1" in scored.columns:
        scored = apply_threshold(scored, threshold)
    else:
        scored = scored.withColumn("prediction_orig", F.col("prediction"))
    if slope is not None and "raw1" in scored.columns:
        return scored.withColumn(
            "confidence", calibrated_confidence(F.col("prediction"), F.col("raw1"), slope, intercept)
        )
    pair = F.array(1.0 - F.col("p1"), F.col("p1")) if "p1" in scored.columns else None
    return scored.withColumn("confidence", confidence(F.col("prediction"), pair))


def fit_calibration(scored: DataFrame) -> tuple[float, float] | None:
    """Slope and intercept of a logistic fit of the label on the raw score, with unit L2 penalty (I16).

    None when the rows with a raw score hold one class only.
    """
    pairs = scored.select(
        array_to_vector(F.array(F.col("raw1").cast("double"))).alias("x"),
        F.col("label").cast("double").alias("y"),
    ).filter(F.col("y").isNotNull() & F.col("raw1").isNotNull())
    usable = F.when(F.col("raw1").isNotNull(), F.col("label"))
    stats = scored.agg(F.count(usable).alias("n"), F.min(usable).alias("lo"), F.max(usable).alias("hi")).first()
    if stats.n == 0 or stats.lo == stats.hi:
        return None
    # Spark averages the loss over the rows, so a unit penalty on the sum is 1/n.
    fit = LogisticRegression(
        featuresCol="x", labelCol="y", regParam=1.0 / stats.n, elasticNetParam=0.0, standardization=False
    ).fit(pairs)
    return float(fit.coefficients[0]), float(fit.intercept)


# --- thresholds ------------------------------------------------------------------------


def threshold_sweep(
    scored: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """``[by,] threshold, tp, fp, fn, f1`` for every threshold, from one pass.

    Each row is counted once, under the number of thresholds it reaches; the
    counts per threshold are then sums over those few groups.
    """
    grid = sorted(thresholds)
    reached = sum(((F.col("p1") >= F.lit(t)).cast("int") for t in grid), F.lit(0))
    positive = F.col("label").cast("int") == 1
    steps = (
        scored.filter(F.col("label").isNotNull() & F.col("p1").isNotNull())
        .groupBy(*by, reached.alias("reached"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    spread = steps.select(*by, "reached", "pos", "neg", F.inline(levels))
    above = F.col("reached") > F.col("level")

    def total(rows: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(rows)).otherwise(0))

    return (
        spread.groupBy(*by, "threshold")
        .agg(total("pos", above).alias("tp"), total("neg", above).alias("fp"), total("pos", ~above).alias("fn"))
        .withColumn("f1", or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    )


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of the highest F1, the lowest among equals, 0.5 when none finds anything."""
    top = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold")))
    found = sweep.groupBy(*by).agg(top.alias("top"))
    return found.select(
        *by,
        F.when(F.col("top.f1") > 0, F.col("top.threshold")).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.col("top.f1").alias("f1"),
    )


# --- choosing a model ------------------------------------------------------------------


def candidate_counts(
    scored: DataFrame,
    predictions: Mapping[str, Column],
    by: Sequence[str] = (),
    classes: int = 2,
    unlabeled: bool = False,
) -> DataFrame:
    """``[by,] algo, label, prediction, cnt`` of several candidates from one scan.

    With few classes, rows are counted under all their predictions together and
    only the counts are told apart by candidate.  With more, that would give
    nearly a group per row, so rows are told apart first; their counts are then
    bounded by candidates times pairs of classes.  Rows without a label are left
    out unless asked for.
    """
    label = F.col("label").cast("int").alias("label")
    decided = [p.cast("int").alias(f"{algo}:decided") for algo, p in predictions.items()]
    rows = scored if unlabeled else scored.filter(F.col("label").isNotNull())
    together = rows.select(*by, label, *decided, F.lit(1).cast("long").alias("cnt"))
    if classes ** (len(predictions) + 1) <= JOINT_GROUPS:
        names = [c for c in together.columns if c != "cnt"]
        together = together.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.sum("cnt").alias("cnt"))
    apart = F.array(
        *[F.struct(F.lit(a).alias("algo"), F.col(f"`{a}:decided`").alias("prediction")) for a in predictions]
    )
    return (
        together.select(*by, "label", "cnt", F.inline(apart))
        .groupBy(*by, "algo", "label", "prediction")
        .agg(F.sum("cnt").alias("cnt"))
    )


def candidate_rank(algo: Column, order: Sequence[str] = CANDIDATES) -> Column:
    position = F.array_position(F.array(*[F.lit(a) for a in order]), algo)
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1))


def choose_best(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The candidate of the highest F1 (E1).  Reduces, so no group meets in one task."""
    fields = [c for c in metrics.columns if c not in by]
    best = F.max_by(F.struct(*fields), F.struct(F.col("f1"), -candidate_rank(F.col("algo"))))
    return metrics.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def choose_default(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Without labels: the random forest, else the first candidate that worked."""
    fields = [c for c in candidates.columns if c not in by]
    order = F.struct((F.col("algo") != DEFAULT_CANDIDATE).cast("int"), candidate_rank(F.col("algo")))
    first = F.min_by(F.struct(*fields), order)
    return candidates.groupBy(*by).agg(first.alias("first")).select(*by, "first.*")


# --- reports ---------------------------------------------------------------------------


def preview(
    scored: DataFrame,
    order: Sequence[str | Column],
    names: Mapping[int, str] | None = None,
    rows: int = PREVIEW_ROWS,
) -> DataFrame:
    """The first scored rows by key with names: ``id, actual, predicted, confidence``.

    Unlabeled rows are shown too, with '-' as the actual class.
    """
    names = names or {}
    key = [F.col(o) if isinstance(o, str) else o for o in order]
    label = F.col("label") if "label" in scored.columns else F.lit(None)
    few = scored.withColumn("_label", label).orderBy(*key).limit(rows)
    position = F.row_number().over(Window.orderBy(*key))
    return few.select(
        position.cast("long").alias("id"),
        F.coalesce(class_name(F.col("_label"), names), F.lit("-")).alias("actual"),
        class_name(F.col("prediction"), names).alias("predicted"),
        F.round("confidence", 4).alias("confidence"),
    )


def top_importances(importances: DataFrame, k: int = 10) -> DataFrame:
    """The k largest ``value``s with their ``name``, ties by name (F1)."""
    return importances.orderBy(F.desc("value"), F.asc("name")).limit(k)
