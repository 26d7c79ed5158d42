from __future__ import annotations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import MinMaxScaler, StringIndexer
from pyspark.sql import functions as F

from sceneforge.operators import features as feat, ranking


def _sample(spark):
    rows = [("a", 1.0, True, 5), ("b", 3.0, False, 5), ("a", 2.0, True, 5), ("c", 5.0, False, 5)]
    return spark.createDataFrame(rows, "s string, x double, b boolean, c int")


def _vectors(df):
    return [list(r.v) for r in df.select(vector_to_array("features").alias("v")).collect()]


def _fitted(df, features, scale=True):
    plan = feat.plan_features(df, features)
    indexer = feat.fit_indexes(df.withColumn("t", F.lit("x")), plan, "t")[1]
    return feat.feature_stages(plan, indexer, scale=scale)


def test_index_equals_the_string_indexer(spark):
    df = spark.createDataFrame([(v,) for v in "bbaaccd"], "s string")
    labels = StringIndexer(inputCol="s", outputCol="i").fit(df).labels
    assert [r.value for r in ranking.frequency_index(df, "s").orderBy("idx").collect()] == list(labels)
    plan = feat.plan_features(df.withColumn("x", F.lit(1)), ["x"])
    assert feat.fit_indexes(df, plan, "s") == (["a", "b", "c", "d"], None)


def test_too_many_classes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(feat, "MOST_CLASSES", 50)
    df = spark.range(200).select(F.col("id").cast("string").alias("t"), "id")
    with pytest.raises(ValueError, match="too many for classes"):
        feat.plan_features(df, ["id"], "t")
    with pytest.raises(ValueError, match="no feature columns"):
        feat.plan_features(df, [], "t")


def test_plan_sorts_features(spark):
    df = _sample(spark)
    plan = feat.plan_features(df, df.columns)
    assert (plan.categories, plan.wide_categories, plan.numbers) == (("s",), (), ("x", "b", "c"))
    wide = feat.plan_features(df, df.columns, max_categories=2)
    assert wide.wide_categories == ("s",) and wide.slot_names == ["s", "x", "b", "c"]
    with pytest.raises(ValueError, match="t"):
        feat.plan_features(df.withColumn("t", F.current_date()), ["x", "t"])


def test_scaled_vector_equals_the_sql_form(spark):
    df = _sample(spark)
    got = _vectors(_fitted(df, df.columns).transform(df))
    indexed = df.join(
        ranking.frequency_index(df, "s").select(F.col("value").alias("s"), F.col("idx").alias("s_idx")), "s"
    ).withColumn("b", F.col("b").cast("int"))
    scaled = feat.minmax_scale(indexed, ["s_idx", "x", "b", "c"])
    want = [[r.s_idx_scaled, r.x_scaled, r.b_scaled, r.c_scaled] for r in scaled.collect()]
    assert sorted(got) == sorted(want)
    assert all(v[3] == 0.5 for v in got)
    raw = _fitted(df, df.columns, scale=False).transform(df)
    spark_scaled = MinMaxScaler(inputCol="features", outputCol="scaled").fit(raw).transform(raw)
    assert sorted(got) == sorted(_vectors(spark_scaled.drop("features").withColumnRenamed("scaled", "features")))


def test_unseen_category_gets_the_extra_index_and_low_values_are_raised(spark):
    df = _sample(spark)
    model = _fitted(df, df.columns)
    new = spark.createDataFrame([("zzz", -100.0, True, 5)], df.schema)
    vector = _vectors(model.transform(new))[0]
    assert vector[0] == 1.5 and vector[1] == 0.0  # index 3 over a range of 2; raised to the smallest


def test_unscaled_features(spark):
    df = _sample(spark)
    model = _fitted(df, ["x", "c"], scale=False)
    assert sorted(_vectors(model.transform(df))) == [[1, 5], [2, 5], [3, 5], [5, 5]]


def test_wide_index_equals_the_indexer(spark):
    df = spark.range(300).select(F.concat(F.lit("v"), (F.col("id") % 23).cast("string")).alias("s"), "id")
    seen = df.filter("s <> 'v7'")
    index = feat.fit_wide_index(seen, "s")
    got = feat.apply_wide_index(df, "s", index).collect()
    model = StringIndexer(inputCol="s", outputCol="i", handleInvalid="keep").fit(seen)
    want = {r.id: r.i for r in model.transform(df).collect()}
    assert len(got) == 300 and all(r[f"s{feat.WIDE_SUFFIX}"] == want[r.id] for r in got)


def test_names_with_brackets_and_slashes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], ["Air_temperature_[K]", "Departure/Arrival (x)"])
    model = _fitted(df, df.columns)
    assert sorted(_vectors(model.transform(df))) == [[0, 0], [1, 1]]


def test_numeric_fallback(spark):
    df = spark.createDataFrame([(1.0, 2, "a"), (None, 2, "b"), (float("nan"), 1, "c")], "x double, y int, s string")
    out = feat.numeric_vector(df, ["x", "y", "s"])
    assert _vectors(out) == [[1.0, 2.0]]
    assert feat.numeric_vector(df, ["s"]) is None


def test_minmax_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    rows = feat.minmax_scale(df, ["a", "b"]).collect()
    assert [(r.a_scaled, r.b_scaled) for r in rows] == [(None, 0.5), (None, None)]
