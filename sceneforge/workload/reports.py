"""Queries on scored tables: confidence, thresholds, metrics, model choice, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneforge.functions import flag, sigmoid
from sceneforge.operators import metrics, scoring
from sceneforge.workload import query
from sceneforge.workload.inputs import (
    LINE_KEY, NAMES, SCORERS, raw_score, scored_lines, sql_raw_score, sql_scored_lines, table,
)

_SCORED = sql_scored_lines()
_NAME_SQL = "CASE {0} WHEN 0 THEN 'Returned or open' WHEN 1 THEN 'Neither' ELSE {0}::VARCHAR END"


@query(f"""
WITH {_SCORED},
n AS (SELECT label, prediction, count(*) AS cnt FROM scored GROUP BY ALL),
l AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INTEGER AS pos FROM (SELECT label FROM scored UNION SELECT prediction FROM scored))
SELECT t.pos AS true_pos, p.pos AS pred_pos, {_NAME_SQL.format('t.label')} AS label_name,
       {_NAME_SQL.format('p.label')} AS prediction_name, coalesce(n.cnt, 0) AS cnt
FROM l t CROSS JOIN l p LEFT JOIN n ON n.label = t.label AND n.prediction = p.label
""")
def confusion_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of labels with its count (the flagship query)."""
    counts = metrics.confusion_counts(scored_lines(spark, sf_dir))
    return metrics.dense_confusion(counts, NAMES)


@query("""
WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
                  CASE WHEN o_totalprice > 300000e0 THEN 0 ELSE 2 END AS prediction, o_orderpriority FROM orders),
n AS (SELECT o_orderpriority, label, prediction, count(*) AS cnt FROM s GROUP BY ALL),
l AS (SELECT o_orderpriority, label FROM s UNION SELECT o_orderpriority, prediction FROM s)
SELECT t.o_orderpriority, t.label AS true_pos, p.label AS pred_pos, t.label::VARCHAR AS label_name,
       p.label::VARCHAR AS prediction_name, coalesce(n.cnt, 0) AS cnt
FROM l t JOIN l p ON t.o_orderpriority = p.o_orderpriority
LEFT JOIN n ON n.o_orderpriority = t.o_orderpriority AND n.label = t.label AND n.prediction = p.label
""")
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes, one matrix per priority; one class is never predicted."""
    status = F.col("o_orderstatus")
    scored = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("label"),
        F.when(F.col("o_totalprice") > 300000, 0).otherwise(2).alias("prediction"),
    )
    by = ["o_orderpriority"]
    return metrics.dense_confusion(metrics.confusion_counts(scored, by), by=by)


@query("""
SELECT DISTINCT 'embeddings' AS source, label FROM embeddings
UNION ALL SELECT DISTINCT 'orders', CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END FROM orders
""")
def labels_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels."""
    status = F.col("o_orderstatus")
    orders = table(spark, sf_dir, "orders").select(
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("label")
    )
    vectors = metrics.sorted_labels(table(spark, sf_dir, "embeddings")).withColumn("source", F.lit("embeddings"))
    return vectors.unionByName(metrics.sorted_labels(orders).withColumn("source", F.lit("orders")))


# --- confidence, calibration, thresholds -----------------------------------------------------


@query(f"""
WITH {_SCORED}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, prediction::DOUBLE AS prediction,
       round(CASE WHEN prediction = 1 THEN p1 ELSE 1e0 - p1 END, 6) AS confidence
FROM scored
""")
def score_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of the predicted class."""
    pair = F.array(1.0 - F.col("p1"), F.col("p1"))
    certainty = F.round(scoring.confidence(F.col("prediction"), pair), 6)
    return scored_lines(spark, sf_dir).select(*LINE_KEY, "prediction", certainty.alias("confidence"))


@query(f"""
WITH {_SCORED},
c AS (SELECT *, 1e0 / (1e0 + exp(-(1.3e0 * raw1 + -0.2e0))) AS cal FROM scored)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, prediction::DOUBLE AS prediction,
       round(cal, 6) AS calibrated, round(CASE WHEN prediction = 1 THEN cal ELSE 1e0 - cal END, 6) AS confidence
FROM c
""")
def platt_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated confidence with given slope and intercept."""
    line = {"slope": 1.3, "intercept": -0.2}
    raw1 = F.col("raw1")
    return scored_lines(spark, sf_dir).select(
        *LINE_KEY,
        "prediction",
        F.round(scoring.calibrated(raw1, **line), 6).alias("calibrated"),
        F.round(scoring.calibrated_confidence(F.col("prediction"), raw1, **line), 6).alias("confidence"),
    )


@query(f"""
WITH {_SCORED},
t AS (SELECT *, CASE WHEN p1 >= 0.35e0 THEN 1e0 ELSE 0e0 END AS tuned FROM scored)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tuned AS prediction,
       prediction::DOUBLE AS prediction_orig,
       round(CASE WHEN tuned = 1 THEN p1 ELSE 1e0 - p1 END, 6) AS confidence
FROM t
""")
def threshold_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions under another threshold; confidence follows the final prediction."""
    tuned = scoring.finish_binary(scored_lines(spark, sf_dir), 0.35, None, None)
    return tuned.select(*LINE_KEY, "prediction", "prediction_orig", F.round("confidence", 6).alias("confidence"))


_SWEEP = f"""
grid AS (SELECT unnest([{", ".join(f"{t}e0" for t in scoring.THRESHOLDS)}]) AS threshold),
sweep AS (
  SELECT l_linestatus, threshold,
         count(*) FILTER (WHERE p1 >= threshold AND label = 1) AS tp,
         count(*) FILTER (WHERE p1 >= threshold AND label = 0) AS fp,
         count(*) FILTER (WHERE p1 < threshold AND label = 1) AS fn
  FROM scored, grid GROUP BY ALL),
scoredsweep AS (SELECT *, coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) AS f1 FROM sweep)
"""


@query(f"WITH {_SCORED}, {_SWEEP} SELECT l_linestatus, threshold, tp, fp, fn, round(f1, 6) AS f1 FROM scoredsweep")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and F1 at eighteen thresholds, per line status."""
    swept = scoring.threshold_sweep(scored_lines(spark, sf_dir), by=["l_linestatus"])
    return swept.withColumn("f1", F.round("f1", 6))


@query(f"""
WITH {_SCORED}, {_SWEEP},
r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY f1 DESC, threshold) AS rk FROM scoredsweep)
SELECT l_linestatus, CASE WHEN f1 > 0 THEN threshold ELSE 0.5e0 END AS threshold, round(f1, 6) AS f1
FROM r WHERE rk = 1
""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the highest F1."""
    swept = scoring.threshold_sweep(scored_lines(spark, sf_dir), by=["l_linestatus"])
    return scoring.best_threshold(swept, by=["l_linestatus"]).withColumn("f1", F.round("f1", 6))


# --- metrics ---------------------------------------------------------------------------------


def _sql_report(source: str, by: str) -> str:
    """Class sums of a table of ``by, label, prediction``."""
    return f"""
sides AS (SELECT {by}, label AS class, 1 AS s, 0 AS p, (label = prediction)::INTEGER AS h FROM {source}
          UNION ALL SELECT {by}, prediction, 0, 1, 0 FROM {source}),
report AS (SELECT {by}, class, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits,
           coalesce(sum(h)::DOUBLE / nullif(sum(p), 0), 0e0) AS precision,
           coalesce(sum(h)::DOUBLE / nullif(sum(s), 0), 0e0) AS recall,
           coalesce(2e0 * sum(h) / nullif(sum(s) + sum(p), 0), 0e0) AS f1
           FROM sides GROUP BY ALL)
"""


@query(f"""
WITH {_SCORED}, {_sql_report('scored', 'l_linestatus')}
SELECT l_linestatus, class, support, predicted, hits, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1
FROM report
""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 per class."""
    counts = metrics.confusion_counts(scored_lines(spark, sf_dir), by=["l_linestatus"])
    rounded = {c: F.round(c, 6) for c in ("precision", "recall", "f1")}
    return metrics.class_report(counts, by=["l_linestatus"]).withColumns(rounded)


@query(f"""
WITH {_SCORED}, {_sql_report('scored', 'l_linestatus')}
SELECT l_linestatus, sum(support)::BIGINT AS n_rows, round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy,
       round(sum(f1 * support) / sum(support), 6) AS f1
FROM report GROUP BY l_linestatus
""")
def metrics_accuracy_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and weighted F1 from one aggregate."""
    counts = metrics.confusion_counts(scored_lines(spark, sf_dir), by=["l_linestatus"])
    found = metrics.accuracy_f1(counts, by=["l_linestatus"])
    return found.withColumns({"accuracy": F.round("accuracy", 6), "f1": F.round("f1", 6)})


@query(f"""
WITH {_SCORED}
SELECT tp, fp, fn, round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (
  SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM scored)
""")
def binary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, false alarms, misses and F1 of class 1."""
    found = metrics.binary_counts(metrics.confusion_counts(scored_lines(spark, sf_dir)))
    return found.withColumn("f1", F.round("f1", 6))


@query("""
SELECT CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE label::VARCHAR END AS name, count(*) AS value
FROM embeddings GROUP BY ALL
UNION ALL
SELECT CASE l_linenumber WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE l_linenumber::VARCHAR END, count(*)
FROM lineitem GROUP BY ALL
""")
def prediction_distribution_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per class under display names, the number where there is none."""
    names = {0: "zero", 1: "one"}
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "prediction")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "prediction")
    return metrics.prediction_distribution(vectors, names).unionByName(
        metrics.prediction_distribution(lines, names)
    )


# --- choosing a model --------------------------------------------------------------------------


def _candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("label", flag(F.col("l_returnflag") == "N"))
    decided = {
        algo: F.when(sigmoid(raw_score(algo)) >= 0.5, 1.0).otherwise(0.0) for algo in SCORERS
    }
    return scoring.candidate_counts(lines, decided, by=["l_linestatus"])


_SQL_TAGGED = "tagged AS (" + " UNION ALL ".join(
    f"""SELECT l_linestatus, '{algo}' AS algo, {rank} AS algo_rank,
        CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS label,
        CASE WHEN 1e0 / (1e0 + exp(-{sql_raw_score(algo)})) >= 0.5e0 THEN 1 ELSE 0 END AS prediction FROM lineitem"""
    for rank, algo in enumerate(SCORERS)
) + ")"
_SQL_METRICS = f"""
{_sql_report('tagged', 'l_linestatus, algo, algo_rank')},
m AS (SELECT l_linestatus, algo, algo_rank, sum(support)::BIGINT AS n_rows,
             sum(hits)::DOUBLE / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS f1
      FROM report GROUP BY ALL)
"""


@query(f"""
WITH {_SQL_TAGGED}, {_SQL_METRICS},
r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY f1 DESC, algo_rank) AS rk FROM m)
SELECT l_linestatus, algo, n_rows, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM r WHERE rk = 1
""")
def auto_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four candidates scored in one pass, the best one by F1."""
    by = ["l_linestatus"]
    found = metrics.accuracy_f1(_candidate_counts(spark, sf_dir), by=[*by, "algo"])
    best = scoring.choose_best(found, by)
    return best.withColumns({"accuracy": F.round("accuracy", 6), "f1": F.round("f1", 6)})


@query("""
WITH c AS (SELECT DISTINCT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'naive_bayes' WHEN 'O' THEN 'gbdt'
             ELSE CASE WHEN o_orderpriority < '3' THEN 'random_forest' ELSE 'xgboost' END END AS algo FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (algo = 'random_forest') DESC,
             list_position(['random_forest', 'gbdt', 'xgboost', 'naive_bayes'], algo)) AS rk FROM c)
SELECT o_orderpriority, algo FROM r WHERE rk = 1
""")
def auto_select_unlabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without labels the random forest, else the first that worked."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    worked = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.when(status == "F", "naive_bayes")
        .when(status == "O", "gbdt")
        .when(priority < "3", "random_forest")
        .otherwise("xgboost")
        .alias("algo"),
    )
    return scoring.choose_default(worked, by=["o_orderpriority"])


# --- previews ----------------------------------------------------------------------------------


@query(f"""
WITH {_SCORED},
f AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id
      FROM scored)
SELECT id, {_NAME_SQL.format('label')} AS actual, {_NAME_SQL.format('prediction')} AS predicted,
       round(CASE WHEN prediction = 1 THEN p1 ELSE 1e0 - p1 END, 4) AS confidence
FROM f WHERE id <= 100
""")
def preview_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred scored rows with names."""
    scored = scoring.finish_binary(scored_lines(spark, sf_dir), None, None, None)
    return scoring.preview(scored, [*LINE_KEY, "l_extendedprice"], NAMES)


@query("""
SELECT p_brand AS name, round(avg(p_retailprice), 6) AS value FROM part GROUP BY p_brand
ORDER BY avg(p_retailprice) DESC, name LIMIT 10
""")
def topk_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the ten largest values by name."""
    prices = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(
        F.avg("p_retailprice").alias("value")
    )
    return scoring.top_importances(prices).withColumn("value", F.round("value", 6))
