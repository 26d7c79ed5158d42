"""Queries that run whole jobs whose results SQL can reproduce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneforge.functions import sigmoid
from sceneforge.plans.enlarge import enlarge_table
from sceneforge.plans.reports import profile_table, suggest_target
from sceneforge.session import scratch_path
from sceneforge.streaming.landing import score_landing, watch
from sceneforge.workload import query
from sceneforge.workload.inputs import GAPPY_SQL, gappy_lines, table
from sceneforge.workload.tables import _GAPPY_TYPES, _sql_profile


@query(f"""
WITH {GAPPY_SQL}, p AS ({_sql_profile('gappy', _GAPPY_TYPES)})
SELECT p.*, CASE WHEN null_pct > 50 THEN printf('Column "%s" has %.1f%% missing values (threshold: %.0f%%)',
       name, null_pct, 50e0) END AS warning
FROM p
""")
def job_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of a table with its warnings."""
    return profile_table(gappy_lines(spark, sf_dir)).columns


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_SQL_ORDER_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS ordinal, trim({c}::VARCHAR) AS value FROM orders"
    for i, c in enumerate(_ORDER_COLUMNS)
    if c not in ("o_totalprice", "o_orderdate")
)


@query(f"""
WITH v AS ({_SQL_ORDER_VALUES} UNION ALL
           SELECT 'fraud_label', 4, (o_totalprice > 250000)::VARCHAR FROM orders),
f AS (SELECT column_name, ordinal, value, count(*) AS cnt FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rk FROM f)
SELECT column_name, (CASE ordinal WHEN 5 THEN 3 ELSE ordinal END)::INTEGER AS ordinal,
       count(*) AS distinct_values, count(*) <= 2 AS is_candidate, column_name = 'fraud_label' AS is_guess,
       string_agg(CASE WHEN rk <= 5 THEN value END, '~' ORDER BY rk) AS sample_values
FROM r GROUP BY ALL
""")
def job_suggest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table with the target it most likely has."""
    orders = table(spark, sf_dir, "orders").withColumn("fraud_label", F.col("o_totalprice") > 250000)
    told = suggest_target(orders.drop("o_totalprice", "o_orderdate"))
    return told.withColumn("sample_values", F.array_join("sample_values", "~"))


@query("""
SELECT ((s_suppkey + n * (replica + 1)))::BIGINT AS supplier_id, s_name, s_nationkey,
  round(s_acctbal * (1e0 + (('0x' || substr(md5(concat_ws('|', s_suppkey, replica, 's_acctbal')), 1, 8))::BIGINT
        / 4294967296e0 * 0.02e0 - 0.01e0)), 4) AS s_acctbal
FROM supplier, (SELECT count(*) AS n FROM supplier), range(0, 4) AS r(replica)
""")
def job_amplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table amplified into a larger stored one."""
    seed, large = scratch_path(spark, "seed") + ".parquet", scratch_path(spark, "large") + ".parquet"
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"),
        "s_name",
        F.col("s_nationkey").cast("string").alias("s_nationkey"),
        "s_acctbal",
    )
    supplier.write.parquet(seed)
    enlarge_table(spark, seed, large, ["supplier_id"], copies=4)
    return spark.read.parquet(large).select(
        "supplier_id", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"),
        F.round("s_acctbal", 4).alias("s_acctbal"),
    )


@query("""
SELECT event_id, event_type, CASE WHEN p1 >= 0.5e0 THEN 1e0 ELSE 0e0 END AS prediction, round(p1, 6) AS p1
FROM (SELECT *, 1e0 / (1e0 + exp(-(-1.5e0 + 0.03e0 * value))) AS p1 FROM events)
""")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: a landed file scored by a stream, once and whole."""

    def score(events: DataFrame) -> DataFrame:
        p1 = sigmoid(F.lit(-1.5) + F.lit(0.03) * F.col("value"))
        return events.select(
            "event_id", "event_type", F.when(p1 >= 0.5, 1.0).otherwise(0.0).alias("prediction"), F.round(p1, 6).alias("p1")
        )

    landed = watch(spark, sf_dir, table(spark, sf_dir, "events").schema, glob="events.parquet")
    out = scratch_path(spark, "scored")
    run = score_landing(landed, score, out, scratch_path(spark, "stream-state"))
    run.awaitTermination()
    return spark.read.parquet(out)
