"""Scoring a table with one model or the best of all (N2), as a logged run (K6-K8)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from sceneforge.functions import class_name, quoted
from sceneforge.operators import features as feat, learners, metrics, registry, runlog, scoring
from sceneforge.plans.prepare import RAW_TARGET, ROW_KEY, add_label, class_names, prepare
from sceneforge.plans.train import known_events, version_folder, wide_path
from sceneforge.scenes import Scene
from sceneforge.session import write_out
from sceneforge.sources.results import append_results
from sceneforge.sources.tables import read_table

INPUT = "_input"


@dataclass(frozen=True)
class Loaded:
    """A saved model with the numbers its version registered."""

    algo: str
    entry: Row
    stages: tuple[Transformer, ...]
    model: Model

    def prediction(self, binary: bool) -> Column:
        plain = F.col(f"{self.algo}:prediction")
        if not binary or self.entry.threshold is None or not learners.has_probability(self.model):
            return plain
        return F.when(self._p(1) >= F.lit(self.entry.threshold), 1.0).otherwise(0.0)

    def confidence(self, binary: bool) -> Column:
        if binary and self.entry.slope is not None:
            raw1 = F.element_at(vector_to_array(F.col(f"{self.algo}:raw")), 2)
            return scoring.calibrated_confidence(
                self.prediction(binary), raw1, self.entry.slope, self.entry.intercept
            )
        has = learners.has_probability(self.model)
        return scoring.confidence(
            self.prediction(binary), vector_to_array(F.col(f"{self.algo}:probability")) if has else None
        )

    def _p(self, index: int) -> Column:
        return F.element_at(vector_to_array(F.col(f"{self.algo}:probability")), index + 1)


class Scorer:
    """The current models of a scene, ready to score batch tables and streams alike."""

    def __init__(self, spark: SparkSession, scene: Scene, models_root: str, key: Sequence[str] = ()):
        self.scene, self.key = scene, tuple(key)
        events = known_events(spark, models_root).filter(F.col("scene_id") == scene.scene_id)
        head = registry.version_heads(events).first()
        if head is None:
            raise ValueError(f"scene {scene.scene_id} has no trained model")
        self.version = head.current_version
        self.folder = version_folder(models_root, self.version)
        entries = registry.latest_models(events).filter(F.col("version") == self.version).collect()
        self.entries = {e.algo: e for e in entries}
        self.failures: dict[str, str] = {}
        self._loaded: dict[str, Loaded] = {}

    @property
    def some_entry(self) -> Row:
        """Any model's entry; classes and features are the same for all models of a version."""
        return next(iter(self.entries.values()))

    @property
    def classes(self) -> list[str]:
        return self.some_entry.class_values

    @property
    def binary(self) -> bool:
        return len(self.classes) == 2

    @property
    def names(self) -> dict[int, str]:
        return class_names(self.scene, self.classes)

    def load(self, algo: str) -> Loaded | None:
        """The saved model; None when it is missing or unreadable, with the reason kept."""
        if algo not in self._loaded and algo not in self.failures:
            if algo not in self.entries:
                self.failures[algo] = f"no {algo} model in version {self.version}"
                return None
            try:
                whole = PipelineModel.load(self.entries[algo].model_path)
            except Exception as error:  # a broken model must not stop the other candidates
                self.failures[algo] = str(error).splitlines()[0]
                return None
            *stages, model = whole.stages
            self._loaded[algo] = Loaded(
                algo, self.entries[algo], tuple(stages), learners.with_output_names(model, algo)
            )
        return self._loaded.get(algo)

    def candidates(self, algos: Sequence[str] = scoring.CANDIDATES) -> list[Loaded]:
        usable = [m for m in map(self.load, algos) if m is not None]
        if not usable:
            reasons = "; ".join(f"{a}: {why}" for a, why in self.failures.items())
            raise RuntimeError(f"all models failed: {reasons}")
        return usable

    def featurize(self, df: DataFrame, stages: Sequence[Transformer], first: int | None = None) -> DataFrame:
        """Row key, label and feature vector of each row, next to the prepared row as a struct.

        Only the first rows by key when asked, picked before any model runs.
        """
        table, names = prepare(df, self.scene, self.key)
        if first is not None:
            table = table.orderBy(ROW_KEY).limit(first)
        own = [c for c in (ROW_KEY, RAW_TARGET) if c in table.columns]
        carried = ", ".join(quoted(c) for c in table.columns if c not in own)
        slim = table.selectExpr(*own, f"struct({carried}) AS {INPUT}", *map(quoted, names))
        slim = add_label(slim, self.classes)
        for name in self.some_entry.wide_columns or []:
            index = df.sparkSession.read.parquet(wide_path(self.folder, self.scene.scene_id, name))
            slim = feat.apply_wide_index(slim, name, index)
        label = ["label"] if "label" in slim.columns else []
        return feat.transform_with(slim, *stages).select(ROW_KEY, INPUT, *label, "features")

    def score(self, df: DataFrame, models: Sequence[Loaded], first: int | None = None) -> DataFrame:
        """The table with one prediction and confidence column per model, in one pass.

        The models of a version share their feature stages, so those run once.
        """
        return feat.transform_with(self.featurize(df, models[0].stages, first), *[m.model for m in models])

    def decided(self, df: DataFrame, models: Sequence[Loaded], first: int | None = None) -> DataFrame:
        """The prepared table with each model's final prediction, its own choice and the confidence, in one pass."""
        scored = self.score(df, models, first)
        made = {}
        for m in models:
            made[f"{m.algo}:final"] = m.prediction(self.binary)
            made[f"{m.algo}:prediction"] = F.col(f"{m.algo}:prediction")
            made[f"{m.algo}:confidence"] = m.confidence(self.binary)
        label = ["label"] if "label" in scored.columns else []
        return scored.select(ROW_KEY, INPUT, *label, *[c.alias(name) for name, c in made.items()])

    def rows_of(self, decided: DataFrame, model: Loaded) -> DataFrame:
        """Rows of one model: the input's columns, prediction, its name, confidence and label."""
        prediction = F.col(f"{model.algo}:final")
        made = {
            "row_key": F.col(ROW_KEY),
            "prediction": prediction,
            "prediction_orig": F.col(f"{model.algo}:prediction"),
            "predicted": class_name(prediction, self.names),
            "confidence": F.col(f"{model.algo}:confidence"),
        }
        if "label" in decided.columns:
            made["label"] = F.col("label")
        carried = [f for f in decided.schema[INPUT].dataType.fieldNames() if f not in made]
        told = decided.select(INPUT, *[c.alias(name) for name, c in made.items()])
        return told.selectExpr(*[f"{INPUT}.{quoted(f)} AS {quoted(f)}" for f in carried], *made)

    def final_rows(self, df: DataFrame, model: Loaded, first: int | None = None) -> DataFrame:
        """Scored rows of one model, straight from the table (batch or stream)."""
        return self.rows_of(self.decided(df, [model], first), model)


@dataclass(frozen=True)
class Scored:
    """Outcome of scoring a table."""

    model: str
    rows: DataFrame
    counts: DataFrame
    accuracy: float | None
    f1: float | None
    names: dict[int, str]
    importances: list[tuple[str, float]]
    first_rows: Callable[[int], DataFrame]

    @property
    def labeled(self) -> DataFrame:
        return self.counts.filter(F.col("label").isNotNull())

    def distribution(self) -> DataFrame:
        return (
            self.counts.groupBy("prediction")
            .agg(F.sum("cnt").alias("value"))
            .select(class_name(F.col("prediction"), self.names).alias("name"), "value")
        )

    def confusion(self) -> DataFrame:
        return metrics.dense_confusion(self.labeled, self.names)

    def report(self) -> DataFrame:
        return metrics.class_report(self.labeled)

    def preview(self, rows: int = scoring.PREVIEW_ROWS) -> DataFrame:
        """The first rows by key, from the stored scores."""
        return scoring.preview(self.first_rows(rows), ["row_key"], self.names, rows)

    def result(self) -> dict:
        """The report as plain values, with the cells of the confusion matrix that are not 0.

        Every part is bounded by classes or by the preview size.
        """
        cells = self.labeled.groupBy("label", "prediction").agg(F.sum("cnt").alias("cnt")).orderBy("label", "prediction").collect()
        axis = sorted({c for r in cells for c in (r.label, r.prediction) if c is not None})
        place = {c: k for k, c in enumerate(axis)}
        top = sorted(self.importances, key=lambda pair: (-pair[1], pair[0]))[:10]
        return {
            "accuracy": self.accuracy,
            "f1": self.f1,
            "final_model": self.model,
            "distribution": [r.asDict() for r in self.distribution().orderBy("name").collect()],
            "confusion_matrix": [
                {"pred_pos": place[r.prediction], "true_pos": place[r.label], "cnt": r.cnt} for r in cells if r.prediction is not None
            ],
            "all_labels_indices": [self.names.get(c, str(c)) for c in axis],
            "feature_importance": [{"name": n, "value": v} for n, v in top],
            "classification_report": [
                {
                    "name": self.names.get(r["class"], str(r["class"])),
                    "precision": r.precision, "recall": r.recall, "f1": r.f1, "support": r.support,
                }
                for r in self.report().orderBy("class").collect()
            ],
            "chart_data": [r.asDict() for r in self.preview().orderBy("id").collect()],
        }


def _decided(df: DataFrame, scorer: Scorer, models: list) -> list[tuple[DataFrame, list]]:
    """Scored rows of all models, written once, each table with its models.

    If the joint pass fails, every model has one of its own, and those that fail alone are left out; the
    reasons are kept in ``scorer.failures``, that of the joint pass under ``joint``. Without any left the failure stands.
    """
    try:
        return [(write_out(scorer.decided(df, models), "scored"), models)]
    except Exception as failure:
        if len(models) == 1:
            raise
        scorer.failures["joint"] = str(failure).splitlines()[0]
        last = failure
    found = []
    for model in models:
        try:
            found.append((write_out(scorer.decided(df, [model]), "scored"), [model]))
        except Exception as failure:
            scorer.failures[model.algo] = str(failure).splitlines()[0]
            last = failure
    if not found:
        raise last
    return found


def score_table(df: DataFrame, scorer: Scorer, model: str = "auto") -> Scored:
    """Score with the named model, or with the candidate of the highest F1 on this table.

    All candidates score the table in one pass, which is written to the shared folder; the counts that compare
    them, the rows and the preview are read from there, so the input is scanned and scored once. Without
    labels there is nothing to compare, so only the default candidate runs.
    """
    labeled = RAW_TARGET in prepare(df, scorer.scene, scorer.key)[0].columns
    models = scorer.candidates(scoring.CANDIDATES if model == "auto" else [model])
    if model == "auto" and not labeled:
        models = [next((m for m in models if m.algo == scoring.DEFAULT_CANDIDATE), models[0])]
    tables, parts = _decided(df, scorer, models), []
    for table, able in tables:
        wide = table if labeled else table.withColumn("label", F.lit(None).cast("double"))
        finals = {m.algo: F.col(f"{m.algo}:final") for m in able}
        parts.append(scoring.candidate_counts(wide, finals, classes=len(scorer.classes), unlabeled=True))
    counts = write_out(reduce(DataFrame.unionByName, parts), "counts")
    stored = {m.algo: (table, m) for table, able in tables for m in able}
    best = scoring.choose_best(
        metrics.accuracy_f1(counts.filter(F.col("label").isNotNull()), by=["algo"])
    ).first()
    table, chosen = stored[best.algo] if best is not None and best.algo in stored else next(iter(stored.values()))
    rows = scorer.rows_of(table, chosen)
    return Scored(
        model=chosen.algo,
        rows=rows,
        counts=counts.filter(F.col("algo") == chosen.algo).drop("algo"),
        accuracy=None if best is None or best.accuracy is None else float(best.accuracy),
        f1=None if best is None or best.f1 is None else float(best.f1),
        names=scorer.names,
        importances=[(f["name"], f["value"]) for f in chosen.entry.features or []],
        first_rows=lambda n: rows.orderBy("row_key").limit(n),
    )


def run_logged(
    spark: SparkSession,
    path: str,
    scene: Scene,
    models_root: str,
    log_path: str,
    result_path: str,
    task_id: int,
    model: str = "auto",
    key: Sequence[str] = (),
    out: str | None = None,
    schema: T.StructType | str | None = None,
) -> str:
    """Score a stored table as a run: open it, note its progress, close it with its result.

    Without a ``schema`` the types of a CSV table are inferred. A failure closes the run as
    failed, with the reason as its result.
    """

    def log(rows: DataFrame) -> None:
        runlog.append_log(rows, log_path)

    def step(**fields) -> DataFrame:
        row = {"task_id": task_id, "seq": time.time_ns() // 1000, **fields}
        kinds = {"task_id": "long", "seq": "long", "accuracy": "double"}
        return spark.createDataFrame(
            [tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row)
        )

    opened = step(scene_type=scene.scene_id, file_path=path, model_type=model)
    log(runlog.open_rows(opened.withColumn("predict_time", F.current_timestamp())))
    try:
        log(runlog.progress_rows(step(model_progress_status=runlog.READING)))
        scored = score_table(read_table(spark, path, schema=schema), Scorer(spark, scene, models_root, key), model)
        log(runlog.progress_rows(step(current_model=scored.model, model_progress_status=runlog.REPORTING)))
        if out is not None:
            scored.rows.write.mode("append").parquet(out)
        result, status, accuracy = scored.result(), "completed", scored.accuracy or 0.0
    except Exception as error:
        result, status, accuracy = {"error": str(error).splitlines()[0]}, "failed", 0.0
    text = json.dumps(result, ensure_ascii=False)
    done = step(accuracy=accuracy, status=status, result_json=text)
    log(runlog.close_rows(done.withColumn("finish_time", F.current_timestamp())))
    append_results(done.withColumn("scene_id", F.lit(scene.scene_id)), result_path)
    return status
