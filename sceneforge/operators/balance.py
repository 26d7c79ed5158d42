"""Class histogram, splits by row key, and oversampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sceneforge.functions import hash_percent, hash_unit, look_up
from sceneforge.session import write_out

# Classes whose rates travel inside the plan as literals.
LITERAL_CLASSES = 1_000

IMBALANCE_LIMIT = 2.0
COPY_CAP = 10.0


def class_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))


def class_count(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count_distinct(label).alias("classes"))


def imbalance(histogram: DataFrame) -> DataFrame:
    """Largest over smallest class, and whether that calls for oversampling."""
    ratio = F.max("cnt") / F.min("cnt")
    return histogram.agg(
        F.count(F.lit(1)).alias("classes"),
        F.max("cnt").alias("max_cnt"),
        F.min("cnt").alias("min_cnt"),
        ratio.alias("ratio"),
    ).withColumn("oversample", F.coalesce(F.col("ratio") > IMBALANCE_LIMIT, F.lit(False)))


def split_name(key: Sequence[str], shares: Sequence[tuple[str, int]]) -> Column:
    """Part a row belongs to; the shares are percentages that add up to 100.

    The part follows from the row key, so it is the same on every layout and
    every retry, and copies of a row never fall into two parts.
    """
    if sum(s for _, s in shares) != 100:
        raise ValueError("shares must add up to 100")
    bucket, upto, chosen = hash_percent(*key), 0, F
    for name, share in shares[:-1]:
        upto += share
        chosen = chosen.when(bucket < upto, F.lit(name))
    return F.lit(shares[0][0]) if len(shares) == 1 else chosen.otherwise(F.lit(shares[-1][0]))


def hash_split(
    df: DataFrame,
    key: Sequence[str],
    shares: Sequence[tuple[str, int]] = (("train", 80), ("test", 20)),
    name: str = "part",
) -> DataFrame:
    return df.withColumn(name, split_name(key, shares))


def class_rates(histogram: DataFrame, largest: int, cap: float) -> DataFrame:
    """Copies wanted per row of each class: up to the largest class, at most ``cap``."""
    rate = F.least(F.lit(largest) / F.col("cnt"), F.lit(float(cap)))
    return histogram.withColumn("rate", F.when(F.col("cnt") < largest, rate).otherwise(1.0))


def oversample(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    cap: float = COPY_CAP,
    limit: float = IMBALANCE_LIMIT,
    literal_classes: int = LITERAL_CLASSES,
) -> DataFrame:
    """Repeat rows of the smaller classes when the classes differ by more than ``limit``.

    A class of rate r gives every row floor(r) copies and one more with
    probability r - floor(r), drawn from the row key.  All classes are handled
    in one pass over the table, without a shuffle: the histogram is reduced
    first and the rates it gives enter the plan as literals.  A target with
    very many classes gets its rates by a salted join.  Copies stay in the task of
    their row: ``deal`` a table first whose rows lie together by class.
    """
    histogram = class_histogram(df, label).filter(F.col(label).isNotNull())
    few = {r[label]: r["cnt"] for r in histogram.limit(literal_classes + 1).collect()}
    if not few:
        return df
    if len(few) <= literal_classes:
        largest, smallest = max(few.values()), min(few.values())
    else:
        largest, smallest = histogram.agg(F.max("cnt"), F.min("cnt")).first()
    if largest / smallest <= limit:
        return df
    if len(few) <= literal_classes:
        rates = {c: min(largest / n, float(cap)) if n < largest else 1.0 for c, n in few.items()}
        rated = df.withColumn("_rate", look_up(F.col(label), rates, F.lit(1.0)))
    else:
        rated = _salted_rates(df, class_rates(histogram, largest, cap), label, key)
    whole = F.floor("_rate")
    extra = (hash_unit(*key) < F.col("_rate") - whole).cast("int")
    copies = F.sequence(F.lit(1), (whole + extra).cast("int"))
    return rated.withColumn("_copy", F.explode(copies)).drop("_rate", "_copy")


def _by_class(df: DataFrame, classes: DataFrame, label: str, key: Sequence[str], salts: int = 64) -> DataFrame:
    """The columns of ``classes`` beside the rows of each class, null for rows of none; a class of any size is met by ``salts`` tasks."""
    salted = df.withColumn("_salt", F.floor(hash_unit(*key) * salts).cast("int"))
    copies = classes.withColumnRenamed(label, "_class").withColumn("_copy_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    matched = (F.col(label) == F.col("_class")) & (F.col("_salt") == F.col("_copy_of"))
    return salted.join(copies, matched, "left").drop("_salt", "_class", "_copy_of")


def _salted_rates(df: DataFrame, rates: DataFrame, label: str, key: Sequence[str]) -> DataFrame:
    joined = _by_class(df, rates.select(label, F.col("rate").alias("_rate")), label, key)
    return joined.withColumn("_rate", F.coalesce("_rate", F.lit(1.0)))


def poisson_steps(rate: str, most: float) -> Column:
    """Probabilities of at most 0, 1, 2, ... draws at a rate up to ``most``; the last is 1 but for 1e-10."""
    last = math.ceil(most + 7 * math.sqrt(most) + 10)
    return F.expr(f"""aggregate(
        sequence(1, {last}), named_struct('p', exp(-{rate}), 'steps', array(exp(-{rate}))),
        (s, k) -> named_struct('p', s.p * {rate} / k, 'steps', concat(s.steps, array(element_at(s.steps, -1) + s.p * {rate} / k))),
        s -> s.steps)""")


def resample_randomly(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    cap: float = COPY_CAP,
    limit: float = IMBALANCE_LIMIT,
    seed: int = 42,
    literal_classes: int = LITERAL_CLASSES,
) -> DataFrame:
    """The same balance by draws with replacement: a bootstrap of every class but the largest.

    A row of a class of rate r is drawn a Poisson number of times with mean r, none
    included: the inverse of the distribution at a number from the row key and
    ``seed``. Every layout and retry draws the same rows, in one pass for classes of
    any number. Rows without a label and of the largest classes are kept once.
    """
    histogram = write_out(class_histogram(df, label).filter(F.col(label).isNotNull()), "classes")
    told = histogram.agg(F.count("*").alias("n"), F.max("cnt").alias("largest"), F.min("cnt").alias("smallest")).first()
    if not told.n or told.largest / told.smallest <= limit:
        return df
    rates = class_rates(histogram, told.largest, cap).filter(F.col("cnt") < told.largest)
    steps = rates.select(label, poisson_steps("rate", cap).alias("_steps"))
    if told.n <= literal_classes:
        steps = steps.withColumnRenamed(label, "_class")
        rated = df.join(F.broadcast(steps), F.col(label) == F.col("_class"), "left").drop("_class")
    else:
        rated = _by_class(df, steps, label, key)
    unit = hash_unit(F.lit(str(seed)), *key)
    # the number is the element of an array so that it is worked out once a row
    drawn = F.transform(F.array(unit), lambda u: F.size(F.filter("_steps", lambda c: c <= u)))[0]
    copies = F.when(F.col("_steps").isNull(), 1).otherwise(drawn)
    return rated.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("_steps", "_copy")


def deal(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows dealt to tasks by their key, so that the rows of each class, and later their copies, are spread evenly.

    Done before rows are repeated, every row moves once instead of every copy.
    """
    return df.repartition(*key)
