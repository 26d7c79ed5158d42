from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sceneforge.operators import columns
from sceneforge.plans.prepare import RAW_TARGET, add_label, prepare
from sceneforge.scenes import Scene, load_scenes


def test_names_are_trimmed_and_underscored(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" a b", "c.d", "Air_temperature_[K]"])
    assert columns.tidy_columns(df).columns == ["a_b", "c_d", "Air_temperature_[K]"]


def test_colliding_names_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], ["a b", "a.b"])
    with pytest.raises(ValueError, match="a_b"):
        columns.tidy_columns(df)


def test_missing_columns_are_named_up_to_five(spark):
    df = spark.createDataFrame([(1,)], ["Churn"])
    with pytest.raises(ValueError, match=r"^18 required columns are missing: CashbackAmount, CityTier, .*\.\.\.$"):
        columns.check_required(df, load_scenes()["shop_churn"])
    with pytest.raises(ValueError, match="^1 required columns are missing: b$"):
        columns.check_required(df, Scene("s", "Churn", ("b", "Churn")))


def test_unlabeled_table_can_be_scored(spark):
    df = spark.createDataFrame([(1,)], ["a"])
    scene = Scene("s", "t", ("a", "t"))
    columns.check_required(df, scene, need_target=False)
    with pytest.raises(ValueError):
        columns.check_required(df, scene)


def test_whitelist_keeps_ids_and_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["ID", "a", "t", "noise", "User_ID"])
    kept = columns.keep_known(df, Scene("s", "t", ("a", "t")))
    assert kept.columns == ["ID", "a", "t", "User_ID"]
    assert columns.keep_known(df, Scene("s", "t")).columns == df.columns


def test_feature_names_leave_out_ids_target_and_ignored(spark):
    names = ["id", "Order_ID", "Time", "Pass/Fail", "unnamed:_0", "157", "a", "t", "k"]
    df = spark.createDataFrame([tuple(range(len(names)))], names)
    scene = Scene("s", "t", ignored=frozenset({"157"}))
    assert columns.feature_names(df, scene, key=["k"]) == ["a"]


def test_fill_by_type(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None), (1, float("nan"), "x", True, None)],
        "i int, d double, s string, b boolean, m decimal(10,2)",
    )
    first, second = columns.fill_nulls(df).collect()
    assert (first.i, first.d, first.s, first.b, first.m) == (0, 0.0, "Unknown", False, 0)
    assert (second.i, second.d, second.s, second.b) == (1, 0.0, "x", True)
    assert columns.fill_nulls(df, skip=["s"]).first().s is None


def test_time_features_become_numbers(spark):
    df = spark.sql("SELECT timestamp'2024-03-05 17:30:00' AS t, date'2023-01-01' AS d, 1 AS x")
    row = columns.time_parts(df, ["t", "d"]).first()
    assert (row.t_year, row.t_month, row.t_weekday, row.t_hour) == (2024, 3, 3, 17)
    assert (row.d_year, row.d_hour, row.x) == (2023, 0, 1)


def test_drift_without_required_columns(spark):
    df = spark.createDataFrame([(1,)], ["a"])
    row = columns.schema_drift(columns.table_columns(df, "t"), []).first()
    assert row.is_match and row.message == "No schema defined for this scene"


def test_drift_lists_ten_names_and_counts_all(spark):
    df = spark.createDataFrame([(1,)], ["a"])
    row = columns.schema_drift(columns.table_columns(df, "t"), [f"c{i:02d}" for i in range(12)]).first()
    assert row.missing_count == 12 and len(row.missing_cols) == 10 and row.extra_cols == ["a"]
    assert row.message == "Missing 12 required feature columns"


def test_column_sets_as_tables(spark):
    actual = spark.createDataFrame([("t", "a"), ("t", "b")], "table_name string, column_name string")
    needed = spark.createDataFrame([("t", "b"), ("t", "c")], "table_name string, column_name string")
    pick = lambda df: [r.column_name for r in df.collect()]
    assert pick(columns.missing_columns(actual, needed)) == ["c"]
    assert pick(columns.extra_columns(actual, needed)) == ["a"]
    assert pick(columns.matching_columns(actual, needed)) == ["b"]


def test_accident_scene_keeps_two_severities(spark):
    scene = load_scenes()["trans_accident"]
    df = spark.createDataFrame([(s,) for s in (1, 2, 3, 4, None)], "Severity int")
    assert sorted(r.Severity for r in scene.prepare(df).collect()) == [2, 3]
    assert scene.prepare(df.withColumnRenamed("Severity", "other")).count() == 5


def test_shipping_flags_treat_missing_as_zero(spark):
    scene = load_scenes()["shop_shipping"]
    df = spark.createDataFrame([(11, 4001), (10, 4000), (None, None)], "Discount_offered int, Weight_in_gms int")
    rows = [(r.High_Discount, r.Is_Heavy) for r in scene.prepare(df).collect()]
    assert rows == [(1, 1), (0, 0), (0, 0)]


def test_quality_scene_derives_target_and_drops_its_source(spark):
    scene = load_scenes()["ind_quality"]
    df = spark.createDataFrame([(1, "t", 0.5, 0.1), (-1, "t", 0.6, 0.2)], ["Pass/Fail", "Time", "85", "0"])
    out = scene.prepare(df)
    assert out.columns == ["0", "Quality"]
    assert [r.Quality for r in out.collect()] == [1, 0]


@pytest.mark.parametrize(
    "values, kind, expected",
    [
        ([1.0, 0.0, float("nan")], "double", ["1", "0", None]),
        ([1, 0, None], "int", ["1", "0", None]),
        ([" satisfied", "other", None], "string", ["satisfied", "other", None]),
        ([True, False, None], "boolean", ["1", "0", None]),
    ],
)
def test_raw_target_is_text_whatever_its_type(spark, values, kind, expected):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"t {kind}, x int")
    table, features = prepare(df, Scene("s", "t"), training=False)
    assert features == ["x"]
    assert [r[RAW_TARGET] for r in table.orderBy("x").collect()] == expected
    assert prepare(df, Scene("s", "t"), training=True)[0].count() == 2


def test_label_follows_the_stored_classes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("new",), (None,)], f"{RAW_TARGET} string")
    assert [r.label for r in add_label(df, ["b", "a"]).collect()] == [0.0, 1.0, None, None]


def test_prepare_refuses_reserved_feature_names(spark):
    df = spark.createDataFrame([(1, 2)], ["label", "t"])
    with pytest.raises(ValueError, match="label"):
        prepare(df, Scene("s", "t"))
    table, features = prepare(df, Scene("s", "label"))
    assert features == ["t"] and RAW_TARGET in table.columns


def test_remap_drops_other_values(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "s int")
    out = columns.remap_label(df, "s", {2: 0.0, 3: 1.0})
    assert [r.label for r in out.orderBy("s").collect()] == [0.0, 1.0]


def test_numeric_label_of_text_is_null(spark):
    df = spark.createDataFrame([("1",), ("satisfied",)], "t string")
    assert [r.v for r in df.select(columns.numeric_label("t").alias("v")).collect()] == [1.0, None]


def test_numeric_names(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS d, true AS b, 'x' AS s, current_date() AS t, 2.5BD AS m")
    assert columns.numeric_names(df, df.columns) == ["i", "d", "b", "m"]


def test_populated_columns(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", None, None), ("b", None, 2)], "g string, x int, y int")
    got = columns.populated_columns(df, F.col("g"), ["x", "y"]).collect()
    assert sorted((r.table_name, r.column_name) for r in got) == [("a", "x"), ("b", "y")]
