"""Profile, frequencies, ranking, balance."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sceneforge.operators import balance, frequencies, profile, ranking
from sceneforge.plans.reports import profile_table, scene_draft, suggest_target
from sceneforge.scenes import Scene


def test_profile_counts_nan_and_ignores_it_in_statistics(spark):
    df = spark.createDataFrame(
        [(1.0, 1, "x"), (float("nan"), None, None), (None, None, "y"), (3.0, 5, "")], "d double, i smallint, s string"
    )
    rows = {r.name: r for r in profile.profile_columns(df).collect()}
    assert (rows["d"].null_count, rows["d"].min, rows["d"].max, rows["d"].mean, rows["d"].std) == (2, 1, 3, 2, 1.41)
    assert (rows["i"].type, rows["i"].null_pct, rows["i"].max) == ("smallint", 50.0, 5)
    assert (rows["s"].null_count, rows["s"].min) == (1, None)


def test_profile_of_decimal_and_all_null(spark):
    df = spark.sql("SELECT CAST(1.255 AS DECIMAL(5,3)) AS m, CAST(NULL AS DOUBLE) AS n")
    rows = {r.name: r for r in profile.profile_columns(df).collect()}
    assert rows["m"].type == "decimal(5,3)" and rows["m"].mean == pytest.approx(1.26)
    assert rows["n"].null_pct == 100.0 and rows["n"].mean is None and rows["m"].std is None


def test_profile_in_rows_of_any_width_is_the_same(spark):
    df = spark.range(10).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(6)], F.when(F.col("id") > 7, "x").alias("s"))
    one = profile.profile_columns(df).collect()
    for width in (1, 3, 7, 9):
        assert sorted(profile.profile_columns(df, cells_per_row=width).collect(), key=lambda r: r.ordinal) == sorted(one, key=lambda r: r.ordinal)
    assert [r.null_count for r in one if r.name == "s"] == [8] and len(one) == 7
    some = profile.profile_columns(df, ["s", "c3"], cells_per_row=1).collect()
    assert sorted((r.name, r.ordinal, r.max) for r in some) == [("c3", 3, 27.0), ("s", 6, None)]


def test_profile_of_a_wide_table_scans_once(spark, tmp_path):
    base = spark.range(200).withColumn("x", F.col("id") / 7)
    base.write.parquet(str(tmp_path / "base"))
    named = [f"IF(id % {i + 2} = 0, NULL, x * {i}) AS `c.{i}`" for i in range(590)]
    wide = spark.read.parquet(str(tmp_path / "base")).selectExpr(*named)
    found = profile.profile_columns(wide)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan
    rows = {r.name: r for r in found.collect()}
    assert len(rows) == 590 and [rows[f"c.{i}"].ordinal for i in range(590)] == list(range(590))
    for i in (0, 1, 11, 12, 300, 589):
        kept = [k / 7 * i for k in range(200) if k % (i + 2)]
        mean = sum(kept) / len(kept)
        std = (sum((v - mean) ** 2 for v in kept) / (len(kept) - 1)) ** 0.5
        row = rows[f"c.{i}"]
        assert (row.total_rows, row.null_count) == (200, 200 - len(kept))
        assert (row.min, row.max, row.mean, row.std) == pytest.approx((min(kept), max(kept), mean, std), abs=0.0051)


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = profile.profile_columns(df).collect()
    assert [(r.total_rows, r.null_count, r.null_pct) for r in rows] == [(0, 0, None), (0, 0, None)]
    assert sorted(profile.profile_columns(df, cells_per_row=1).collect()) == sorted(rows)


def test_warning_above_half_only(spark):
    df = spark.createDataFrame([(None, None), (None, 1), (3, 2), (None, None)], "a int, b int")
    report = profile_table(df, Scene("s", "t", ("a", "t")))
    assert [r.warning for r in report.warnings.collect()] == ['Column "a" has 75.0% missing values (threshold: 50%)']
    drift = report.drift.first()
    assert (drift.is_match, drift.missing_cols, drift.extra_cols) == (False, ["t"], ["b"])


def test_frequencies_trim_and_count_missing_as_empty(spark):
    df = spark.createDataFrame([(" a ",), ("a",), (None,), ("  ",)], "s string")
    got = {r.value: r.cnt for r in frequencies.value_frequencies(df).collect()}
    assert got == {"a": 2, "": 2}


@pytest.mark.parametrize(
    "names, guess",
    [
        (["my_quality", "class_x", "other"], "class_x"),
        (["b_label", "a_label", "other"], "b_label"),
        (["one", "two", "three"], "three"),
        (["wide_class", "two", "DEL15_flag"], "DEL15_flag"),
    ],
)
def test_guess_of_the_target(spark, names, guess):
    df = spark.range(6).select(
        *[
            (F.col("id") if n in ("wide_class", "other", "three") else F.col("id") % 2).alias(n)
            for n in names
        ]
    )
    rows = suggest_target(df).collect()
    assert [r.column_name for r in rows if r.is_guess] == [guess]
    assert {r.column_name for r in rows if r.is_candidate} == set(names) - {"wide_class", "other", "three"}


def test_sample_values_by_count_then_value(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaadefg"], "v string")
    assert suggest_target(df).first().sample_values == ["a", "b", "c", "d", "e"]


def test_few_values_agree_with_full_counts(spark):
    rows = [
        (1, 0.0, True, " a ", None, "x", None, 1.5), (1, -0.0, None, "a", None, "", None, float("nan")), (2, 0.0, False, "b", None, None, "q", 1.5),
        (3, 0.0, True, "a", None, "x", "q", float("nan")), (3, -0.0, True, "b ", None, " x", None, 1.5),
    ]
    df = spark.createDataFrame(rows, "three int, zero double, gap boolean, two string, none date, `text gap` string, one_gap string, n_an double")
    df = df.withColumn("day", F.expr("date_add(DATE'2020-01-01', three % 2)")).withColumn("at", F.expr("CAST(day AS TIMESTAMP)"))
    full = frequencies.value_frequencies(df).collect()
    for r in frequencies.few_values(df).collect():
        values = sorted(f.value for f in full if f.column_name == r.column_name)
        assert r.distinct_values == min(len(values), 3), r
        assert r["values"] == (values if len(values) <= 2 else None)
    empty = frequencies.few_values(df.limit(0)).collect()
    assert all(r.distinct_values == (1 if r.column_name in ("two", "text gap", "one_gap") else 0) or r["values"] == [] for r in empty)


def test_few_values_shuffle_one_row_per_task(spark):
    seen = spark.range(0, 50_000, 1, 4).withColumn("t", F.col("id").cast("string"))
    got = {r.column_name: r.distinct_values for r in frequencies.few_values(seen).collect()}
    assert got == {"id": 3, "t": 3}


def test_scene_draft(spark):
    df = spark.createDataFrame([(1, "x"), (0, "y"), (1, "z")], "churned int, s string")
    scene = scene_draft(df, "new")
    assert scene.target == "churned" and scene.labels == {"1": "Class_1", "0": "Class_0"}
    assert scene.required == ("churned", "s")


@pytest.mark.parametrize("rows_per_task", [1, 7, 10_000])
def test_frequency_index_is_the_same_however_it_is_spread(spark, rows_per_task):
    df = spark.range(200).select(F.concat(F.lit("v"), (F.col("id") * F.col("id") % 37).cast("string")).alias("v"))
    got = ranking.frequency_index(df, "v", rows_per_task)
    counts = {r.value: r.cnt for r in got.collect()}
    expected = sorted(counts, key=lambda v: (-counts[v], v))
    assert [r.value for r in got.orderBy("idx").collect()] == expected
    assert sorted(r.idx for r in got.collect()) == list(range(len(expected)))


def test_number_rows_over_several_tasks(spark):
    df = spark.range(1000).repartition(5)
    got = ranking.number_rows(df, [F.desc("id")], rows_per_task=130)
    assert all(r.row_number == 1000 - r.id for r in got.collect())


def _classes(spark, **sizes):
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "k string, label string")


def test_oversampling_reaches_the_largest_class(spark):
    out = balance.oversample(_classes(spark, a=1000, b=300, c=1000), ["k"])
    got = {r.label: r.cnt for r in balance.class_histogram(out).collect()}
    assert got["a"] == got["c"] == 1000 and 950 <= got["b"] <= 1050


def test_oversampling_is_capped(spark):
    out = balance.oversample(_classes(spark, a=1000, b=5), ["k"], cap=10)
    assert out.filter("label = 'b'").count() == 50


def test_no_oversampling_up_to_ratio_two(spark):
    df = _classes(spark, a=20, b=10)
    assert balance.oversample(df, ["k"]).count() == 30
    assert balance.oversample(df.limit(0), ["k"]).count() == 0
    assert balance.resample_randomly(df, ["k"]).count() == 30
    assert balance.resample_randomly(df.limit(0), ["k"]).count() == 0


def test_many_classes_get_the_same_copies_by_join(spark):
    df = _classes(spark, a=500, b=77, c=140, d=500)
    few = balance.oversample(df, ["k"]).collect()
    joined = balance.oversample(df, ["k"], literal_classes=2).collect()
    assert sorted(few) == sorted(joined)


def test_rows_without_label_are_kept_once(spark):
    df = _classes(spark, a=100, b=10).unionByName(spark.createDataFrame([("n", None)], "k string, label string"))
    assert balance.oversample(df, ["k"]).filter("label IS NULL").count() == 1


def _poisson(u, rate):
    k, p = 0, math.exp(-rate)
    upto = p
    while upto <= u:
        k += 1
        p = p * rate / k
        upto += p
    return k


def test_random_resampling(spark):
    df = _classes(spark, a=2000, b=400, c=30).unionByName(spark.createDataFrame([("n", None)], "k string, label string"))
    drawn = balance.resample_randomly(df, ["k"], seed=7).collect()
    assert sorted(map(str, drawn)) == sorted(map(str, balance.resample_randomly(df.repartition(3), ["k"], seed=7, literal_classes=2).collect()))
    assert sorted(map(str, drawn)) != sorted(map(str, balance.resample_randomly(df, ["k"], seed=8).collect()))
    copies = Counter((r.k, r.label) for r in drawn)
    for r in df.collect():
        unit = int(hashlib.md5(f"7|{r.k}".encode()).hexdigest()[:8], 16) / 2**32
        assert copies[(r.k, r.label)] == {"b": _poisson(unit, 5.0), "c": _poisson(unit, 10.0)}.get(r.label, 1), r
    sizes = Counter(r.label for r in drawn)
    assert (sizes["a"], sizes[None]) == (2000, 1) and 1800 <= sizes["b"] <= 2200
    assert 0 < sum((f"b{i}", "b") not in copies for i in range(400)) < 20  # draws leave rows out, about one in 148


def test_random_resampling_of_very_many_classes(spark):
    rows = [(i * 10 + j, i) for i in range(1500) for j in range(1 + 3 * (i % 2))]
    df = spark.createDataFrame(rows, "k long, label long")
    drawn = balance.resample_randomly(df, ["k"])
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    sizes = Counter(r.label % 2 for r in drawn.collect())
    assert sizes[1] == 3000 and 2700 <= sizes[0] <= 3300


def test_dealt_rows_spread_copies_evenly(spark):
    df = spark.range(0, 40000, 1, 8).select("id", (F.col("id") >= 36000).cast("int").alias("label"))  # sorted by class
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def largest(of):
            return of.groupBy(F.spark_partition_id()).count().agg(F.max("count") / F.avg("count")).first()[0]

        for balanced in (balance.oversample, balance.resample_randomly):
            assert largest(balanced(df, ["id"])) > 3
            assert largest(balanced(balance.deal(df, ["id"]), ["id"])) < 1.2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)



def test_split_follows_the_key_not_the_layout(spark):
    df = spark.range(5000)
    shares = (("train", 60), ("tune", 20), ("test", 20))
    one = balance.hash_split(df, ["id"], shares).collect()
    other = balance.hash_split(df.repartition(7), ["id"], shares).collect()
    assert sorted(one) == sorted(other)
    sizes = [sum(r.part == p for r in one) / 5000 for p, _ in shares]
    assert sizes == pytest.approx([0.6, 0.2, 0.2], abs=0.03)
    with pytest.raises(ValueError):
        balance.split_name(["id"], (("train", 80),))


def test_imbalance(spark):
    row = balance.imbalance(balance.class_histogram(_classes(spark, a=9, b=3, c=3))).first()
    assert (row.classes, row.max_cnt, row.min_cnt, row.ratio, row.oversample) == (3, 9, 3, 3.0, True)
    assert balance.class_count(_classes(spark, a=2, b=1)).first().classes == 2


def test_stored_profile_of_a_wide_csv(spark):
    from sceneforge.plans.reports import profile_stored
    from sceneforge.session import scratch_path

    path = scratch_path(spark, "wide") + ".csv"
    wide = spark.range(20).select(*[(F.col("id") * i).alias(f"c {i}") for i in range(30)])
    wide.write.option("header", True).csv(path)
    rows = {r.name: r for r in profile_stored(spark, path).columns.collect()}
    assert len(rows) == 30 and rows["c_29"].max == 29 * 19 and rows["c_0"].ordinal == 0
