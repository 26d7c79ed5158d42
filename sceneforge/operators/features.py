"""Feature preparation: category indexing, assembly, scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from sceneforge.functions import column, is_text, quoted, text
from sceneforge.operators.columns import numeric_names
from sceneforge.operators.ranking import frequency_index

# Categories a string indexer may hold on the driver and in every model copy.
# A column with more gets its index by a join with a written frequency table.
INDEXER_CATEGORIES = 100_000

WIDE_SUFFIX = "_wide_idx"

# Suffix of the scaled copy of a column.
SCALED = ":scaled"


# Columns whose ranges one aggregation finds.
RANGES_PER_PASS = 40

# Classes a target may have; more than this is no classification.
MOST_CLASSES = 100_000


@dataclass(frozen=True)
class FeaturePlan:
    """Which columns become features, how, and between which values the numbers lie."""

    categories: tuple[str, ...]
    wide_categories: tuple[str, ...]
    numbers: tuple[str, ...]
    ranges: Mapping[str, tuple[float, float]]

    @property
    def inputs(self) -> list[str]:
        """Columns assembled, in order; each fills one slot of the vector."""
        return [
            *[f"{c}_idx" for c in self.categories],
            *[f"{c}{WIDE_SUFFIX}" for c in self.wide_categories],
            *self.numbers,
        ]

    @property
    def slot_names(self) -> list[str]:
        """Name to show for each vector slot."""
        return [*self.categories, *self.wide_categories, *self.numbers]


def plan_features(
    df: DataFrame, features: Sequence[str], target: str | None = None, max_categories: int = INDEXER_CATEGORIES
) -> FeaturePlan:
    """Sort features into numbers, categories, and categories too many for an indexer.

    The number of categories and classes is estimated by one aggregation.  The
    estimate only chooses the way of indexing; both ways give the same index.
    """
    texts = [f.name for f in df.schema.fields if f.name in features and is_text(f)]
    numbers = numeric_names(df, features)
    odd = sorted(set(features) - set(texts) - set(numbers))
    if odd:
        raise ValueError(f"no way to use these columns as features: {', '.join(odd)}")
    if not features:
        raise ValueError("no feature columns")
    counted = [*texts, *([target] if target else [])]
    found = (
        df.selectExpr(*[f"approx_count_distinct({quoted(c)}) AS {quoted('n:' + c)}" for c in counted]).first()
        if counted
        else {}
    )
    if target and found[f"n:{target}"] > MOST_CLASSES:
        raise ValueError(f"the target has about {found[f'n:{target}']} values, too many for classes")
    return FeaturePlan(
        categories=tuple(c for c in texts if found[f"n:{c}"] <= max_categories),
        wide_categories=tuple(c for c in texts if found[f"n:{c}"] > max_categories),
        numbers=tuple(numbers),
        ranges=number_ranges(df, numbers),
    )


def number_ranges(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value per column; one job, one row per column.

    Parts of forty columns keep each aggregation a single compiled loop.
    """
    parts = []
    for i in range(0, len(names), RANGES_PER_PASS):
        some = names[i : i + RANGES_PER_PASS]
        ends = [
            f"{fn}(CAST({quoted(c)} AS DOUBLE)) AS {quoted(f'{fn}:{c}')}" for c in some for fn in ("min", "max")
        ]
        rows = ", ".join(
            f"named_struct('name', {text(c)}, 'low', {quoted('min:' + c)}, 'high', {quoted('max:' + c)})" for c in some
        )
        parts.append(df.selectExpr(*ends).selectExpr(f"inline(array({rows}))"))
    if not parts:
        return {}
    return {r.name: (r.low or 0.0, r.high or 0.0) for r in reduce(DataFrame.unionAll, parts).collect()}


def fit_indexes(df: DataFrame, plan: FeaturePlan, target: str) -> tuple[list[str], StringIndexerModel | None]:
    """Classes of the target and the index of the categories, from one pass.

    Classes and categories are numbered by falling count, ties by name; this is
    the one place that says which class has which index.  A category not seen
    here gets an extra index.
    """
    names = [target, *plan.categories]
    fitted = StringIndexer(
        inputCols=names, outputCols=[f"{c}_idx" for c in names], handleInvalid="keep"
    ).fit(df)
    classes, *categories = fitted.labelsArray
    if not categories:
        return list(classes), None
    indexer = StringIndexerModel.from_arrays_of_labels(
        [list(c) for c in categories],
        list(plan.categories),
        [f"{c}_idx" for c in plan.categories],
        handleInvalid="keep",
    )
    return list(classes), indexer


def feature_stages(
    plan: FeaturePlan,
    indexer: StringIndexerModel | None,
    wide_sizes: Mapping[str, int] | None = None,
    scale: bool = True,
) -> PipelineModel:
    """Index, scale to [0, 1], assemble, all from what was found before, so without another pass.

    Scaling is a projection of plain arithmetic.  A table to be scored can have
    numbers below the smallest one found here; they are raised to it, since
    naive Bayes refuses negative features.  ``scale=False`` leaves the values as
    they are, which trees do not mind.
    """
    stages: list[Transformer] = [] if indexer is None else [indexer]
    if not scale:
        return PipelineModel([*stages, VectorAssembler(inputCols=plan.inputs, outputCol="features")])
    ranges = dict(plan.ranges)
    if indexer is not None:
        sizes = {c: len(labels) for c, labels in zip(plan.categories, indexer.labelsArray)}
        ranges.update({f"{c}_idx": (0.0, float(max(n - 1, 0))) for c, n in sizes.items()})
    for c, n in (wide_sizes or {}).items():
        ranges[f"{c}{WIDE_SUFFIX}"] = (0.0, float(max(n - 1, 0)))
    scaled = ", ".join(f"{_scaled(c, *ranges[c])} AS {quoted(c + SCALED)}" for c in plan.inputs)
    assembler = VectorAssembler(inputCols=[c + SCALED for c in plan.inputs], outputCol="features")
    return PipelineModel([*stages, SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), assembler])


def _scaled(name: str, low: float, high: float) -> str:
    if low == high:
        return "0.5D"
    number = f"CAST('{low!r}' AS DOUBLE)"
    return f"(greatest(CAST({quoted(name)} AS DOUBLE), {number}) - {number}) / CAST('{high - low!r}' AS DOUBLE)"


# --- wide categories -------------------------------------------------------------------


def fit_wide_index(df: DataFrame, name: str) -> DataFrame:
    return frequency_index(df, name).select("value", "idx")


def apply_wide_index(df: DataFrame, name: str, index: DataFrame, salts: int = 32) -> DataFrame:
    """Add the index by a shuffled join, unseen values getting the next free index.

    A few values may hold most rows, so each row goes to one of ``salts``
    copies of its key and the index table carries every copy.
    """
    unseen = index.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[column(c) for c in df.columns]), F.lit(salts)).cast("int"))
    copies = index.select(
        F.col("value").alias("_value"),
        F.col("idx").alias("_idx"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_copy"),
    )
    matched = (column(name) == F.col("_value")) & (F.col("_salt") == F.col("_copy"))
    return (
        salted.join(copies, matched, "left")
        .withColumn(f"{name}{WIDE_SUFFIX}", F.coalesce("_idx", F.lit(unseen)).cast("double"))
        .drop("_salt", "_value", "_idx", "_copy")
    )


# --- without a fitted model ------------------------------------------------------------


def numeric_vector(df: DataFrame, features: Sequence[str]) -> DataFrame | None:
    """Vector of the numeric features alone, rows with a missing one dropped; None without any."""
    numbers = numeric_names(df, features)
    if not numbers:
        return None
    return VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="skip").transform(df)


def minmax_scale(df: DataFrame, names: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Add each column scaled to [0, 1] by its own range; 0.5 where the range is a point (I4).

    The ranges are one row of numbers from one aggregation and enter the
    second pass as literals.
    """
    bounds = df.agg(
        *[F.min(column(c).cast("double")).alias(f"lo:{c}") for c in names],
        *[F.max(column(c).cast("double")).alias(f"hi:{c}") for c in names],
    ).first()
    scaled = {}
    for c in names:
        low, high = bounds[f"lo:{c}"], bounds[f"hi:{c}"]
        x = column(c).cast("double")
        if low is None:
            scaled[c + suffix] = F.lit(None).cast("double")
        elif low == high:
            scaled[c + suffix] = F.when(x.isNotNull(), 0.5)
        else:
            scaled[c + suffix] = (x - F.lit(low)) / F.lit(high - low)
    return df.withColumns(scaled)


def transform_with(df: DataFrame, *stages: Transformer) -> DataFrame:
    for stage in stages:
        df = stage.transform(df)
    return df
