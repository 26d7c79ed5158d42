"""Queries on the model registry, the run log, result texts and amplification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneforge.functions import hash_unit
from sceneforge.operators import amplify as amp, registry, runlog
from sceneforge.session import scratch_path
from sceneforge.sources import results
from sceneforge.workload import query
from sceneforge.workload.inputs import table

# --- registry ----------------------------------------------------------------------------------

_SQL_EVENTS = """
reg AS (SELECT o_orderpriority AS scene_id, (1 + o_custkey % 5)::INTEGER AS version,
               CASE o_orderstatus WHEN 'F' THEN 'random_forest' WHEN 'O' THEN 'gbdt' ELSE 'naive_bayes' END AS algo,
               o_orderkey * 2 AS seq, 'order ' || o_orderkey AS dataset, o_orderkey AS rows,
               o_totalprice / 1e6 AS accuracy, o_totalprice / 2e6 AS f1_score, o_custkey AS train_size,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS trained_at
        FROM orders),
req AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-HIGH'
               WHEN 'HOUSEHOLD' THEN '3-MEDIUM' WHEN 'FURNITURE' THEN '5-LOW' ELSE 'nowhere' END AS scene_id,
               (1 + c_nationkey % 7)::INTEGER AS version, c_custkey * 20 + 1 AS seq FROM customer),
act AS (SELECT * FROM req WHERE EXISTS
        (SELECT 1 FROM reg WHERE reg.scene_id = req.scene_id AND reg.version = req.version)),
ev AS (SELECT scene_id, version, seq, 'register' AS event FROM reg
       UNION ALL SELECT scene_id, version, seq, 'activate' FROM act),
heads AS (SELECT scene_id, arg_max(version, seq) AS current_version,
          (coalesce(max(version) FILTER (WHERE event = 'register'), 0) + 1)::INTEGER AS next_version,
          count(DISTINCT version) FILTER (WHERE event = 'register') AS n_versions FROM ev GROUP BY scene_id),
lastreg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, version, algo ORDER BY seq DESC) AS rk
            FROM reg) WHERE rk = 1)
"""


def _registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return registry.register_events(
        table(spark, sf_dir, "orders").select(
            F.col("o_orderpriority").alias("scene_id"),
            (1 + F.col("o_custkey") % 5).cast("int").alias("version"),
            F.when(status == "F", "random_forest").when(status == "O", "gbdt").otherwise("naive_bayes").alias("algo"),
            (F.col("o_orderkey") * 2).alias("seq"),
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("dataset"),
            F.col("o_orderkey").alias("rows"),
            (F.col("o_totalprice") / 1e6).alias("accuracy"),
            (F.col("o_totalprice") / 2e6).alias("f1_score"),
            F.col("o_custkey").alias("train_size"),
            F.col("o_orderdate").cast("timestamp").alias("event_time"),
        )
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    scene = (
        F.when(segment == "BUILDING", "1-URGENT")
        .when(segment == "MACHINERY", "2-HIGH")
        .when(segment == "HOUSEHOLD", "3-MEDIUM")
        .when(segment == "FURNITURE", "5-LOW")
        .otherwise("nowhere")
    )
    return table(spark, sf_dir, "customer").select(
        scene.alias("scene_id"),
        (1 + F.col("c_nationkey") % 7).cast("int").alias("version"),
        (F.col("c_custkey") * 20 + 1).alias("seq"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = _registrations(spark, sf_dir)
    activated = registry.activate_events(_requests(spark, sf_dir), registered)
    return registered.unionByName(activated, allowMissingColumns=True)


@query(f"""
WITH {_SQL_EVENTS}
SELECT scene_id, current_version, next_version, n_versions,
       CASE WHEN current_version = 1 THEN '' ELSE 'v' || current_version END AS models_subdir
FROM heads
""")
def registry_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current and next version, and where the models lie."""
    events = _events(spark, sf_dir)
    return registry.version_heads(events).withColumn("models_subdir", registry.subdir(F.col("current_version")))


@query(f"""
WITH {_SQL_EVENTS},
v AS (SELECT scene_id, version, max(seq) AS registered_seq, arg_max(trained_at, seq) AS trained_at, arg_max(dataset, seq) AS dataset,
             arg_max(rows, seq) AS rows,
             string_agg(algo || ':' || train_size, ',' ORDER BY algo) AS trained_on,
             round(max(accuracy), 6) AS best_accuracy
      FROM lastreg GROUP BY ALL)
SELECT v.*, CASE WHEN version = 1 THEN '' ELSE 'v' || version END AS models_subdir,
       version = current_version AS is_current
FROM v JOIN heads USING (scene_id, )
""".replace("(scene_id, )", "(scene_id)"))
def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions, when they were trained, and the metrics of their models."""
    listed = registry.list_versions(_events(spark, sf_dir))
    entries = F.map_entries("models")
    told = F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"]["train_size"].cast("string")))
    best = F.array_max(F.transform(entries, lambda e: e["value"]["accuracy"]))
    return listed.withColumns(
        {"trained_on": F.array_join(told, ","), "best_accuracy": F.round(best, 6)}
    ).drop("models")


@query(f"""
WITH {_SQL_EVENTS},
scenes AS (SELECT DISTINCT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '3-MEDIUM' WHEN c_mktsegment = 'BUILDING'
           THEN '1-URGENT' ELSE c_mktsegment END AS scene_id FROM customer)
SELECT s.scene_id, coalesce(h.current_version, 1) AS current_version, a.algo,
       round(m.accuracy, 6) AS accuracy, round(m.f1_score, 6) AS f1_score, m.seq IS NOT NULL AS trained, m.trained_at,
       CASE WHEN m.seq IS NOT NULL THEN 'completed' ELSE 'idle' END AS training
FROM scenes s CROSS JOIN (VALUES ('random_forest'), ('gbdt'), ('xgboost'), ('naive_bayes')) AS a(algo)
LEFT JOIN heads h ON h.scene_id = s.scene_id
LEFT JOIN lastreg m ON m.scene_id = s.scene_id AND m.version = coalesce(h.current_version, 1) AND m.algo = a.algo
""")
def registry_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scene with every algorithm and its state."""
    segment = F.col("c_mktsegment")
    scenes = table(spark, sf_dir, "customer").select(
        F.when(segment == "HOUSEHOLD", "3-MEDIUM").when(segment == "BUILDING", "1-URGENT").otherwise(segment)
        .alias("scene_id")
    ).distinct()
    grid = registry.status_grid(scenes, _events(spark, sf_dir))
    return grid.withColumns({"accuracy": F.round("accuracy", 6), "f1_score": F.round("f1_score", 6)})


@query(f"""
WITH {_SQL_EVENTS}
SELECT scene_id, version, seq, 'Version ' || version || ' not found' AS message
FROM req WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.scene_id = req.scene_id AND reg.version = req.version)
""")
def registry_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: activation requests for versions that were never registered."""
    return registry.unknown_requests(_requests(spark, sf_dir), _registrations(spark, sf_dir))


@query(f"""
WITH {_SQL_EVENTS}
SELECT scene_id, version, algo, seq, dataset, round(accuracy, 6) AS accuracy, train_size, trained_at FROM lastreg
""")
def registry_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to the stored registry and read back, the last of each kept."""
    path = scratch_path(spark, "registry")
    registry.append_events(_events(spark, sf_dir), path)
    latest = registry.latest_models(registry.read_events(spark, path))
    return latest.select(
        "scene_id", "version", "algo", "seq", "dataset", F.round("accuracy", 6).alias("accuracy"), "train_size", "trained_at"
    )


# --- run log -----------------------------------------------------------------------------------

_SQL_LOG = """
log AS (
  SELECT user_id AS task_id, event_id AS seq,
    CASE WHEN event_type = 'signup' THEN CASE WHEN value < 10 THEN 'unknown' ELSE 'scene_' || (user_id % 4) END END
      AS scene_type,
    CASE WHEN event_type = 'signup' THEN ts END AS predict_time,
    CASE WHEN event_type IN ('purchase', 'error') THEN ts END AS finish_time,
    CASE WHEN event_type = 'signup' THEN 'in/' || event_id || '.csv' END AS file_path,
    CASE WHEN event_type = 'signup' THEN 'auto' END AS model_type,
    CASE event_type WHEN 'signup' THEN 0e0 WHEN 'purchase' THEN value WHEN 'error' THEN 0e0 END AS accuracy,
    CASE event_type WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END
      AS status,
    CASE event_type WHEN 'purchase' THEN props WHEN 'error' THEN substr(props, 1, 4) END AS result_json,
    CASE event_type WHEN 'click' THEN 'model ' || (event_id % 4) WHEN 'view' THEN NULL ELSE 'None' END
      AS current_model,
    CASE event_type WHEN 'signup' THEN 'Task queued...' WHEN 'view' THEN 'Evaluating ' || (event_id % 4)
      WHEN 'click' THEN NULL ELSE 'Complete' END AS model_progress_status
  FROM events),
state AS (SELECT task_id, max(seq) AS seq, """ + ", ".join(
    f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in runlog.STATE_FIELDS
) + " FROM log GROUP BY task_id)"


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of runs: sign-ups open them, clicks and views note progress, the rest close them."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("kind"),
        "ts",
        "value",
        "props",
        F.concat(F.lit("model "), (F.col("event_id") % 4).cast("string")).alias("model"),
        F.concat(F.lit("Evaluating "), (F.col("event_id") % 4).cast("string")).alias("stage"),
        F.when(F.col("value") < 10, "  ")
        .otherwise(F.concat(F.lit("scene_"), (F.col("user_id") % 4).cast("string")))
        .alias("scene"),
        F.concat(F.lit("in/"), F.col("event_id").cast("string"), F.lit(".csv")).alias("path"),
    )


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log in one pass over the events."""
    kind = F.col("kind")
    opens, done, fails = kind == "signup", kind == "purchase", kind == "error"
    closes = done | fails
    return _run_events(spark, sf_dir).select(
        "task_id",
        "seq",
        F.when(opens, runlog.scene_or_unknown(F.col("scene"))).alias("scene_type"),
        F.when(opens, F.col("ts")).alias("predict_time"),
        F.when(closes, F.col("ts")).alias("finish_time"),
        F.when(opens, F.col("path")).alias("file_path"),
        F.when(opens, F.lit("auto")).alias("model_type"),
        F.when(done, F.col("value")).when(opens | fails, 0.0).alias("accuracy"),
        F.when(opens, runlog.OPEN["status"]).when(done, "completed").when(fails, "failed").alias("status"),
        F.when(done, F.col("props")).when(fails, F.substring("props", 1, 4)).alias("result_json"),
        F.when(opens, runlog.OPEN["current_model"])
        .when(closes, runlog.CLOSED["current_model"])
        .when(kind == "click", F.col("model"))
        .alias("current_model"),
        F.when(opens, runlog.OPEN["model_progress_status"])
        .when(closes, runlog.CLOSED["model_progress_status"])
        .when(kind == "view", F.col("stage"))
        .alias("model_progress_status"),
    )


@query(f"WITH {_SQL_LOG} SELECT * FROM log")
def runlog_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, K7, K8: opening, progress and closing rows of all runs, each kind by its own operator."""
    events, kind = _run_events(spark, sf_dir), F.col("kind")
    done = kind == "purchase"
    opened = events.filter(kind == "signup").select(
        "task_id",
        "seq",
        F.col("scene").alias("scene_type"),
        F.col("ts").alias("predict_time"),
        F.col("path").alias("file_path"),
        F.lit("auto").alias("model_type"),
    )
    closed = events.filter(kind.isin("purchase", "error")).select(
        "task_id",
        "seq",
        F.when(done, F.col("value")).otherwise(0.0).alias("accuracy"),
        F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(done, F.col("props")).otherwise(F.substring("props", 1, 4)).alias("result_json"),
        F.col("ts").alias("finish_time"),
    )
    clicked = events.filter(kind == "click").withColumnRenamed("model", "current_model")
    viewed = events.filter(kind == "view").withColumnRenamed("stage", "model_progress_status")
    log = runlog.open_rows(opened)
    for step in (runlog.progress_rows(clicked), runlog.progress_rows(viewed), runlog.close_rows(closed)):
        log = log.unionByName(step, allowMissingColumns=True)
    return log.select("task_id", "seq", *runlog.STATE_FIELDS)


@query(f"WITH {_SQL_LOG} SELECT * FROM state")
def runlog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every run, field by field the last value set."""
    return runlog.latest_state(_log(spark, sf_dir))


@query(f"""
WITH {_SQL_LOG} SELECT {", ".join(runlog.HISTORY_FIELDS)} FROM state WHERE scene_type = 'scene_1' ORDER BY task_id DESC
""")
def runlog_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of one scene, newest first."""
    return runlog.history(_log(spark, sf_dir), "scene_1")


@query(f"""
WITH {_SQL_LOG}
SELECT {", ".join(runlog.HISTORY_FIELDS)}, strftime(predict_time, '%Y-%m-%d %H:%M:%S') AS started
FROM state ORDER BY task_id DESC
""")
def runlog_history_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs, a blank scene name being no filter, with start times as text."""
    runs = runlog.history(_log(spark, sf_dir), "  ")
    return runs.withColumn("started", runlog.time_text(F.col("predict_time")))


@query(f"""
WITH {_SQL_LOG}
SELECT task_id, seq, status, accuracy, model_progress_status,
       CASE WHEN json_valid(result_json) THEN (result_json ->> '$.k')::BIGINT END AS result_k
FROM state WHERE task_id = 7
""")
def task_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run by its id."""
    found = runlog.task_status(_log(spark, sf_dir), 7, "k long")
    return found.select(
        "task_id", "seq", "status", "accuracy", "model_progress_status", F.col("result.k").alias("result_k")
    )


@query("""
SELECT event_id, event_type AS scene_id,
       CASE WHEN event_type <> 'error' THEN (props ->> '$.k')::BIGINT END AS k,
       event_type = 'error' AS malformed,
       '{"event_id":' || event_id || ',"k":"' || event_type || '"}' AS encoded
FROM events
""")
def runlog_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON results written by scene and parsed back; malformed text gives null."""
    path = scratch_path(spark, "results")
    broken = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props"))
    results.append_results(
        table(spark, sf_dir, "events").select(
            "event_id",
            F.col("event_type").alias("scene_id"),
            broken.alias("result_json"),
            results.encode("event_id", F.col("event_type").alias("k")).alias("encoded"),
        ),
        path,
    )
    stored = spark.read.parquet(path).withColumn("result", results.decode(F.col("result_json"), "k long"))
    return stored.select(
        "event_id", "scene_id", F.col("result.k").alias("k"), F.col("result").isNull().alias("malformed"), "encoded"
    )


# --- amplification -----------------------------------------------------------------------------


@query("""
WITH n AS (SELECT count(*) AS n FROM customer)
SELECT (c_custkey + n * (replica + 1))::BIGINT AS c_custkey, c_name || '_' || replica AS c_name, c_mktsegment,
       replica::INTEGER AS replica
FROM customer, n, range(0, 3) AS r(replica)
""")
def amplify_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies whose ids are shifted or suffixed."""
    seed = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return amp.amplify(seed, 3, ["c_custkey"], ids=["c_custkey", "c_name"], keep_replica=True)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, replica::INTEGER AS replica,
  round(l_quantity * (1e0 + (('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
        replica, 'l_quantity')), 1, 8))::BIGINT / 4294967296e0 * 0.02e0 - 0.01e0)), 6) AS l_quantity,
  l_returnflag, l_size
FROM (SELECT *, (l_linenumber % 7)::INTEGER AS l_size FROM lineitem), range(0, 2) AS r(replica)
""")
def amplify_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures jittered by the row's own noise; codes are left alone."""
    seed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
        (F.col("l_linenumber") % 7).cast("int").alias("l_size"),
    )
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    measured = amp.jitter_columns(seed, key)
    noise = {c: hash_unit(*key, F.col("replica").cast("string"), F.lit(c)) for c in measured}
    copies = amp.replicate(seed, 2).withColumns({c: F.round(amp.jitter(F.col(c), n), 6) for c, n in noise.items()})
    return copies.select(*key, "replica", "l_quantity", "l_returnflag", "l_size")


@query("""
SELECT name, n < 10 AS is_code FROM (
  SELECT 'l_linenumber' AS name, count(DISTINCT l_linenumber) AS n FROM lineitem
  UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem
  UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem)
""")
def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns with fewer than ten distinct values."""
    names = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
    codes = amp.code_columns(table(spark, sf_dir, "lineitem"), names)
    return spark.createDataFrame([(n, n in codes) for n in names], "name string, is_code boolean")


@query("""
SELECT 'orders' AS name, (1000000 // count(*) + 1)::BIGINT AS copies FROM orders
UNION ALL SELECT 'customer', (1000000 // count(*) + 1)::BIGINT FROM customer
""")
def amplify_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies needed to reach a size, here counted in rows."""
    sizes = [(n, table(spark, sf_dir, n).count()) for n in ("orders", "customer")]
    rows = [(n, amp.replicas_for(size, 1_000_000)) for n, size in sizes]
    return spark.createDataFrame(rows, "name string, copies long")
