"""Confusion counts and everything computed from them.

Only ``confusion_counts`` touches the scored table.  What follows works on its
result, which has at most one row per pair of classes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from sceneforge.functions import class_name, or_zero


def confusion_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``[by,] label, prediction, cnt`` of the labeled rows: one pass, counted before the shuffle."""
    label, prediction = F.col("label").cast("int"), F.col("prediction").cast("int")
    return (
        scored.filter(F.col("label").isNotNull())
        .groupBy(*by, label.alias("label"), prediction.alias("prediction"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def sorted_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(F.col(label).cast("int").alias(label)).distinct().orderBy(label)


def dense_confusion(
    counts: DataFrame, names: Mapping[int, str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """A cell for every pair of classes that occur as label or prediction, 0 where no row has it.

    ``true_pos`` and ``pred_pos`` are positions among the sorted classes of the
    group. The cells are made by exploding the classes, one row per class first,
    and get their counts by a join.
    """
    occurring = counts.select(*by, F.explode(F.array("label", "prediction")).alias("class")).filter(F.col("class").isNotNull())
    axis = occurring.groupBy(*by).agg(F.array_sort(F.collect_set("class")).alias("axis"))
    rows = axis.select(*by, "axis", F.posexplode("axis").alias("true_pos", "label"))
    spread = rows.repartition(*by, "label")  # a task has whole rows of the matrix, not whole groups
    cells = spread.select(*by, "true_pos", "label", F.posexplode("axis").alias("pred_pos", "prediction"))
    found = counts.select(*(F.col(c).alias(f"of_{c}") for c in (*by, "label", "prediction")), F.col("cnt").alias("found"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*by, "label", "prediction")]
    both = cells.join(found, same, "left")
    names = names or {}
    return both.select(
        *by,
        "true_pos",
        "pred_pos",
        class_name(F.col("label"), names).alias("label_name"),
        class_name(F.col("prediction"), names).alias("prediction_name"),
        F.coalesce("found", F.lit(0)).cast("long").alias("cnt"),
    )


def class_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support, predicted, hits, precision, recall and F1."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("cnt").alias("support"), none.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), none.alias("support"), F.col("cnt").alias("predicted"), none.alias("hits")),
    )
    sums = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    return (
        sums.withColumn("precision", or_zero(F.col("hits"), F.col("predicted")))
        .withColumn("recall", or_zero(F.col("hits"), F.col("support")))
        .withColumn("f1", or_zero(2 * F.col("hits"), F.col("support") + F.col("predicted")))
    )


def accuracy_f1(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and F1 weighted by class support, both from the one aggregate."""
    total = F.sum("support")
    return class_report(counts, by).groupBy(*by).agg(
        total.alias("n_rows"),
        or_zero(F.sum("hits"), total).alias("accuracy"),
        or_zero(F.sum(F.col("f1") * F.col("support")), total).alias("f1"),
    )


def binary_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn of class 1 and the F1 they give, 0 when there is nothing to find."""

    def total(label: int, prediction: int):
        here = (F.col("label") == label) & (F.col("prediction") == prediction)
        return F.sum(F.when(here, F.col("cnt")).otherwise(0))

    return counts.groupBy(*by).agg(
        total(1, 1).alias("tp"), total(0, 1).alias("fp"), total(1, 0).alias("fn")
    ).withColumn("f1", or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def prediction_distribution(
    scored: DataFrame, names: Mapping[int, str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """``name, value``: rows per predicted class; names are put on after counting."""
    return (
        scored.groupBy(*by, F.col("prediction").cast("int").alias("prediction"))
        .agg(F.count(F.lit(1)).alias("value"))
        .select(*by, class_name(F.col("prediction"), names or {}).alias("name"), "value")
    )
