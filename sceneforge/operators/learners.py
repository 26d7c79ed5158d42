"""Classifiers of a scene and their feature importances."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, NaiveBayes, RandomForestClassifier

from sceneforge.operators.boosting import RegularizedBoosting
from sceneforge.operators.scoring import CANDIDATES

# The settings of the algorithms.
SEED = 42
MAX_BINS = 128
FOREST = {"numTrees": 20, "maxDepth": 8}
BOOSTED = {"rounds": 100, "depth": 6, "rate": 0.1, "l1": 0.5, "l2": 1.0, "rows": 0.8, "columns": 0.8}


def algorithms_for(classes: int) -> list[str]:
    """Candidates that can learn that many classes: plain boosting is binary."""
    return [a for a in CANDIDATES if classes <= 2 or a != "gbdt"]


def classifier(algo: str, classes: int = 2, rounds: int | None = None) -> Estimator:
    """Untrained classifier.  ``xgboost`` is the regularised boosting of this library.

    ``rounds`` overrides the number of boosting rounds.  Plain boosting keeps a
    node id per row and cuts its lineage every ten rounds.
    """
    columns = {"featuresCol": "features", "labelCol": "label"}
    if algo == "random_forest":
        return RandomForestClassifier(**columns, **FOREST, maxBins=MAX_BINS, seed=SEED)
    if algo == "naive_bayes":
        return NaiveBayes(**columns)
    steady = {"maxBins": MAX_BINS, "seed": SEED, "cacheNodeIds": True, "checkpointInterval": 10}
    if algo == "gbdt":
        return GBTClassifier(**columns, **steady, **({"maxIter": rounds} if rounds else {}))
    if algo == "xgboost":
        settings = {**BOOSTED, "bins": MAX_BINS, "seed": SEED, **({"rounds": rounds} if rounds else {})}
        return RegularizedBoosting(**columns, classes=classes, settings=json.dumps(settings))
    raise ValueError(f"unsupported model: {algo}")


def with_output_names(model: Model, algo: str) -> Model:
    """A copy of a fitted classifier whose output columns carry the algorithm's name.

    Several classifiers can then score the same table in one pass.
    """
    named = model.copy()
    named.setPredictionCol(f"{algo}:prediction")
    if named.hasParam("rawPredictionCol"):
        named.set(named.getParam("rawPredictionCol"), f"{algo}:raw")
    if named.hasParam("probabilityCol"):
        named.set(named.getParam("probabilityCol"), f"{algo}:probability")
    return named


def has_probability(model: Model) -> bool:
    return model.hasParam("probabilityCol")


def classifier_of(model: Model | PipelineModel) -> Model:
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def importance_pairs(model: Model | PipelineModel, slots: Sequence[str]) -> list[tuple[str, float]]:
    """Importance per feature of a tree model, named by the vector's own slots; empty for others."""
    found = classifier_of(model)
    if not hasattr(found, "featureImportances"):
        return []
    return list(zip(slots, map(float, found.featureImportances.toArray())))
