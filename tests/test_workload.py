"""Every query against its SQL on the small tables, and the plans Spark makes for them."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from compare import differences, duck
from sceneforge import workload

QUERIES, SQL = workload.QUERIES, workload.SQL
LEARNED = sorted(set(QUERIES) - set(SQL))


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, con, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert costly not in plan
    assert differences(df, con, SQL[name]) == []


def test_only_learned_results_have_no_sql():
    assert LEARNED == [
        "learned_importance", "platt_fit", "scored_run", "train_every_scene", "train_multiclass", "train_score_auto", "train_score_boosted",
        "train_score_gbt", "train_score_nb", "train_score_rf",
    ]
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 4


def test_calibration_line_lowers_log_loss(spark, sf_dir):
    rows = QUERIES["platt_fit"](spark, sf_dir).collect()
    total = sum(r.n_rows for r in rows)
    positive = sum(r.n_rows for r in rows if r["class"] == "1")
    mean = sum(r.mean_calibrated * r.n_rows for r in rows) / total
    assert mean == pytest.approx(positive / total, abs=2e-3)


def test_importances_add_up(spark, sf_dir):
    rows = QUERIES["learned_importance"](spark, sf_dir).collect()
    assert {r.name for r in rows} == {"lang", "source", "n_chars", "n_words"}
    assert sum(r.value for r in rows) == pytest.approx(1, abs=1e-4)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["filter_remap_label"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderstatus, [F,O])" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_top_values_are_cut_before_the_shuffle(spark, sf_dir):
    from sceneforge.operators import frequencies
    from sceneforge.workload.inputs import table

    counted = frequencies.value_frequencies(table(spark, sf_dir, "orders"))
    plan = frequencies.top_values(counted)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sweep_and_choice_scan_the_table_once(spark, sf_dir):
    for name in ("threshold_sweep", "best_threshold", "auto_select", "metrics_accuracy_f1", "profile_columns"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1, name


def test_oversampling_does_not_shuffle(spark, sf_dir):
    plan = QUERIES["oversample_hash"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_entry_survives_a_missing_library():
    code = (
        "import sys, warnings; sys.modules['ahocorasick'] = None; sys.modules['tokenizers'] = None\n"
        "sys.modules['sceneforge.llm'] = None\nimport __spark_entry__ as e; assert 'confusion_dense' in e.queries() and 'pipeline' not in e.queries()"
    )
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
    code = "import sys; sys.modules['numpy.testing'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-W", "always", "-c", code], check=True, cwd=root, timeout=120, capture_output=True, text=True)
    assert int(done.stdout) > 60
