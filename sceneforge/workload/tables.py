"""Queries on reading, columns, labels, profile, frequencies, classes and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneforge.operators import balance, columns, features, frequencies, profile, ranking
from sceneforge.plans.reports import find_target
from sceneforge.scenes import (
    Scene, SCENE_SCHEMA, add_flag, attach_scene, chain, delete_scenes, keep_values, load_scenes, scene_table,
    upsert_scenes,
)
from sceneforge.session import scratch_path
from sceneforge.sources.tables import discover_tables, read_csv, read_table, read_with_scene
from sceneforge.workload import query
from sceneforge.workload.inputs import (
    GAPPY_SQL, LINE_KEY, SQL_LINE_KEY, gappy_lines, labeled_documents, table,
)

# --- sources ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def read_csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: CSV with a declared schema."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    path = scratch_path(spark, "orders") + ".csv"
    orders.write.option("header", True).csv(path)
    return read_csv(spark, path, orders.schema)


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def read_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: CSV whose types are inferred."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch_path(spark, "customer") + ".csv"
    customer.write.option("header", True).csv(path)
    return read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("""
SELECT fmt, count(*) AS n_rows, sum(s_suppkey)::BIGINT AS sum_key, round(sum(s_acctbal), 2) AS sum_balance
FROM supplier, (VALUES ('csv'), ('parquet')) AS f(fmt) GROUP BY fmt
""")
def read_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3, H4: the path's suffix chooses the format."""
    supplier = table(spark, sf_dir, "supplier")
    base = scratch_path(spark, "supplier")
    supplier.write.option("header", True).csv(base + ".csv")
    supplier.write.parquet(base + ".parquet")
    csv = read_table(spark, base + ".csv", schema=supplier.schema).withColumn("fmt", F.lit("csv"))
    both = csv.unionByName(read_table(spark, base + ".parquet").withColumn("fmt", F.lit("parquet")))
    return both.groupBy("fmt").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("s_suppkey").alias("sum_key"),
        F.round(F.sum("s_acctbal"), 2).alias("sum_balance"),
    )


@query("""
SELECT 'shop_churn' AS scene_id, count(*) AS n_rows FROM customer
UNION ALL SELECT 'trans_delay', count(*) FROM orders
""")
def discover_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: table names in a folder give the scenes; unknown ones are skipped."""
    folder = scratch_path(spark, "datasets")
    stored = {"shop_churn_clean": "customer", "trans_delay": "orders", "no_such_scene": "part"}
    for stem, name in stored.items():
        table(spark, sf_dir, name).write.option("header", True).csv(f"{folder}/{stem}.csv")
    scenes = load_scenes()
    rows = spark.read.schema("first string").option("header", True).csv(f"{folder}/*.csv")
    counted = read_with_scene(rows, scenes).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(discover_tables(spark, folder, scenes).select("scene_id"), "scene_id", "left_semi")


@query("""
SELECT s.scene_id, coalesce(d.target_col, '') AS target_col, count(*) AS n_orders
FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'shop_order' WHEN 'O' THEN 'open_orders' ELSE 'ind_quality' END
             AS scene_id FROM orders) s
LEFT JOIN (VALUES ('shop_order', 'ordered_twice'), ('open_orders', 'o_orderstatus')) AS d(scene_id, target_col)
  ON s.scene_id = d.scene_id
GROUP BY ALL
""")
def scene_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes upserted and deleted, then looked up by every order."""
    scenes = load_scenes()
    stored = scene_table(spark, scenes)
    edits = [
        ("shop_order", "Orders", "Shop", "", "ordered", 1),
        ("shop_order", "Orders", "Shop", "", "ordered_twice", 2),
        ("open_orders", "Open orders", "Shop", "", "o_orderstatus", 1),
    ]
    changes = spark.createDataFrame(edits, SCENE_SCHEMA + ", seq long")
    gone = spark.createDataFrame([("ind_quality",)], "scene_id string")
    dim = delete_scenes(upsert_scenes(stored, changes), gone)
    owner = (
        F.when(F.col("o_orderstatus") == "F", "shop_order")
        .when(F.col("o_orderstatus") == "O", "open_orders")
        .otherwise("ind_quality")
    )
    orders = table(spark, sf_dir, "orders").select(owner.alias("scene_id"))
    counted = orders.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n_orders"))
    return attach_scene(counted, dim, len(scenes) + len(edits)).orderBy("scene_id")


# --- columns ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice AS o_total_price, o_orderdate AS order_date FROM orders")
def clean_and_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy names, required columns checked, others dropped."""
    orders = table(spark, sf_dir, "orders")
    untidy = orders.select(
        F.col("o_orderkey").alias(" o_orderkey "),
        F.col("o_totalprice").alias("o_total.price"),
        F.col("o_orderdate").alias("order date"),
        F.col("o_custkey").alias("not wanted"),
        F.col("o_orderpriority").alias("Time"),
    )
    scene = Scene("orders", "order date", ("o_orderkey", "o_total_price", "order_date", "Time"))
    tidy = columns.tidy_columns(untidy)
    columns.check_required(tidy, scene)
    return columns.keep_known(tidy, scene).drop("Time", "absent")


@query(f"""
WITH {GAPPY_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       CASE WHEN isnan(l_discount) THEN 0e0 ELSE l_discount END AS l_discount,
       coalesce(l_tax, 0e0) AS l_tax, coalesce(l_returnflag, 'Unknown') AS l_returnflag,
       coalesce(is_large, false) AS is_large, coalesce(l_linestatus, 'Unknown') AS l_linestatus
FROM gappy
""")
def fill_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults by type for missing values."""
    return columns.fill_nulls(gappy_lines(spark, sf_dir))


def _order_scene() -> Scene:
    return Scene(
        "order_open", "o_orderstatus", labels={"F": "Filled", "O": "Open"}, hook=keep_values("o_orderstatus", ["F", "O"])
    )


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0e0 ELSE 1e0 END AS label
FROM orders WHERE o_orderstatus IN ('F', 'O')
""")
def filter_remap_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene hook keeps two classes, which become 0 and 1."""
    kept = _order_scene().prepare(table(spark, sf_dir, "orders"))
    return columns.remap_label(kept, "o_orderstatus", {"F": 0.0, "O": 1.0}).select("o_orderkey", "label")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_discount > 0.05e0 THEN 1 ELSE 0 END AS high_discount,
       CASE WHEN nullif(l_quantity, 50e0) > 40 THEN 1 ELSE 0 END AS is_heavy,
       CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS not_returned
FROM lineitem
""")
def derive_binary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target and flags derived by conditions; unknown counts as 0."""
    hook = chain(
        add_flag("high_discount", "l_discount > 0.05", needs="l_discount"),
        add_flag("is_heavy", "nullif(l_quantity, 50) > 40", needs="l_quantity"),
        add_flag("not_returned", "l_returnflag = 'N'", needs="l_returnflag"),
    )
    lines = table(spark, sf_dir, "lineitem").transform(hook)
    return lines.select(*LINE_KEY, "high_discount", "is_heavy", "not_returned")


@query("""
SELECT o_orderkey, try_cast(o_orderstatus AS DOUBLE) AS from_text,
       try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS from_digits
FROM orders
""")
def safe_label_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label cast that gives null for text."""
    orders = table(spark, sf_dir, "orders").withColumn("digits", F.substring("o_orderpriority", 1, 1))
    return orders.select(
        "o_orderkey",
        columns.numeric_label("o_orderstatus").alias("from_text"),
        columns.numeric_label("digits").alias("from_digits"),
    )


@query("""
SELECT name, ordinal::INTEGER AS ordinal, n_values FROM (
  SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linestatus']) AS name,
         unnest([4, 5, 6, 7, 9]) AS ordinal,
         unnest([count(l_quantity), count(l_extendedprice), count(l_discount), count(l_tax), count(l_linestatus)])
           AS n_values
  FROM lineitem)
""")
def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature columns of a table and how many values each holds."""
    lines = table(spark, sf_dir, "lineitem").drop("l_shipdate").withColumn("user_id", F.col("l_suppkey"))
    scene = Scene("line_return", "l_returnflag")
    names = columns.feature_names(lines, scene, key=LINE_KEY)
    measured = profile.profile_columns(lines, names)
    return measured.select("name", "ordinal", (F.col("total_rows") - F.col("null_count")).alias("n_values"))


REQUIRED_IN_DRIFT = ["l_discount", "l_quantity", "l_tax", "l_warehouse", "l_linestatus"]


@query(f"""
WITH filled AS (
  SELECT l_returnflag AS table_name,
         unnest([
           CASE WHEN count(l_quantity) > 0 THEN 'l_quantity' END,
           CASE WHEN count(CASE WHEN l_returnflag <> 'A' THEN l_discount END) > 0 THEN 'l_discount' END,
           CASE WHEN count(CASE WHEN l_returnflag <> 'N' THEN l_tax END) > 0 THEN 'l_tax' END,
           CASE WHEN count(l_shipdate) > 0 THEN 'l_shipdate' END]) AS column_name
  FROM lineitem GROUP BY l_returnflag),
have AS (SELECT * FROM filled WHERE column_name IS NOT NULL),
need AS (SELECT unnest({REQUIRED_IN_DRIFT}) AS column_name),
grid AS (SELECT t.table_name, need.column_name FROM (SELECT DISTINCT table_name FROM have) t, need),
missing AS (SELECT * FROM grid EXCEPT SELECT * FROM have),
extra AS (SELECT * FROM have EXCEPT SELECT * FROM grid),
m AS (SELECT table_name, count(*) AS n, string_agg(column_name, ',' ORDER BY column_name) AS names
      FROM missing GROUP BY 1),
e AS (SELECT table_name, count(*) AS n, string_agg(column_name, ',' ORDER BY column_name) AS names
      FROM extra GROUP BY 1)
SELECT h.table_name, coalesce(m.n, 0) = 0 AS is_match, 5::INTEGER AS required_cols,
       count(*)::INTEGER AS actual_cols, (count(*) - coalesce(e.n, 0))::INTEGER AS matching_count,
       coalesce(m.n, 0)::INTEGER AS missing_count, coalesce(e.n, 0)::INTEGER AS extra_count,
       coalesce(m.names, '') AS missing_cols, coalesce(e.names, '') AS extra_cols,
       CASE WHEN coalesce(m.n, 0) > 0 THEN 'Missing ' || m.n || ' required feature columns'
            WHEN coalesce(e.n, 0) > 0 THEN 'Found ' || e.n || ' extra columns (will be ignored)'
            ELSE 'All columns match perfectly' END AS message
FROM have h LEFT JOIN m ON h.table_name = m.table_name LEFT JOIN e ON h.table_name = e.table_name
GROUP BY h.table_name, m.n, m.names, e.n, e.names
""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each return flag is a delivery whose filled columns are compared."""
    kind = F.col("l_returnflag")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        "l_quantity",
        F.when(kind != "A", F.col("l_discount")).alias("l_discount"),
        F.when(kind != "N", F.col("l_tax")).alias("l_tax"),
        "l_shipdate",
    )
    have = columns.populated_columns(lines, kind, ["l_quantity", "l_discount", "l_tax", "l_shipdate"])
    drift = columns.schema_drift(have, REQUIRED_IN_DRIFT)
    return drift.withColumns(
        {"missing_cols": F.array_join("missing_cols", ","), "extra_cols": F.array_join("extra_cols", ",")}
    )


# --- profile and frequencies ---------------------------------------------------------------

_GAPPY_TYPES = {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint",
    "l_quantity": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "is_large": "boolean", "l_linestatus": "string",
}


def _sql_profile(source: str, kinds: dict[str, str]) -> str:
    """The profile of every column by one aggregate each."""

    def one(ordinal: int, name: str, kind: str) -> str:
        value = f"CASE WHEN NOT isnan({name}) THEN {name} END" if kind == "double" else name
        stats = ", ".join(
            f"round({fn}(({value})::DOUBLE), 2) AS \"{alias}\""
            if kind in ("bigint", "int", "double")
            else f"NULL::DOUBLE AS \"{alias}\""
            for alias, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp"))
        )
        return (
            f"SELECT '{name}' AS name, {ordinal}::INTEGER AS ordinal, '{kind}' AS type, count(*) AS total_rows, "
            f"count(*) - count({value}) AS null_count, "
            f"round((count(*) - count({value})) * 100e0 / count(*), 1) AS null_pct, {stats} FROM {source}"
        )

    return " UNION ALL ".join(one(i, n, k) for i, (n, k) in enumerate(kinds.items()))


@query(f"WITH {GAPPY_SQL} {_sql_profile('gappy', _GAPPY_TYPES)}")
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and statistics of every column."""
    return profile.profile_columns(gappy_lines(spark, sf_dir))


@query(f"""
WITH {GAPPY_SQL}, p AS ({_sql_profile('gappy', _GAPPY_TYPES)})
SELECT name, ordinal, printf('Column "%s" has %.1f%% missing values (threshold: %.0f%%)', name, null_pct, 50e0) AS warning
FROM p WHERE null_pct > 50
""")
def profile_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that miss more than half of their values."""
    return profile.missing_warnings(profile.profile_columns(gappy_lines(spark, sf_dir)))


_EVENT_VALUES = """
  SELECT 'event_type' AS column_name, 0 AS ordinal, trim(event_type) AS value FROM {source}
  UNION ALL SELECT 'user_id', 1, user_id::VARCHAR FROM {source}
  UNION ALL SELECT 'props', 2, coalesce(CASE WHEN event_type <> 'view' THEN props END, '') FROM {source}
"""


def _event_frequencies(events: DataFrame) -> DataFrame:
    padded = events.select(
        F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("event_type"),
        "user_id",
        F.when(F.col("event_type") != "view", F.col("props")).alias("props"),
    )
    return frequencies.value_frequencies(padded)


@query(f"""
SELECT column_name, ordinal::INTEGER AS ordinal, value, count(*) AS cnt
FROM ({_EVENT_VALUES.format(source='events')}) GROUP BY ALL
""")
def value_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every value of several columns; missing counts as empty text."""
    return _event_frequencies(table(spark, sf_dir, "events"))


@query(f"""
WITH f AS (SELECT column_name, ordinal, value, count(*) AS cnt
           FROM ({_EVENT_VALUES.format(source='events')}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rk FROM f)
SELECT column_name, ordinal::INTEGER AS ordinal, count(*) AS distinct_values,
       string_agg(CASE WHEN rk <= 5 THEN value END, '~' ORDER BY rk) AS sample_values
FROM r GROUP BY ALL
""")
def distinct_and_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values per column and its five most frequent ones."""
    described = frequencies.describe_values(_event_frequencies(table(spark, sf_dir, "events")))
    return described.withColumn("sample_values", F.array_join("sample_values", "~"))


@query("""
SELECT o_orderpriority AS value, count(*) AS cnt, 'Class_' || o_orderpriority AS default_name
FROM orders GROUP BY ALL ORDER BY cnt DESC, value
""")
def target_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values of a target by falling count."""
    counted = frequencies.value_frequencies(table(spark, sf_dir, "orders"), ["o_orderpriority"])
    return frequencies.target_values(counted, "o_orderpriority")


@query(f"""
WITH few AS (SELECT * FROM events ORDER BY event_id LIMIT 5000)
SELECT column_name, ordinal::INTEGER AS ordinal, value, count(*) AS cnt
FROM ({_EVENT_VALUES.format(source='few')}) GROUP BY ALL
""")
def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value counts of the first 5000 rows by key, the sampling form of the analysis."""
    few = frequencies.first_rows(table(spark, sf_dir, "events"), ["event_id"])
    return _event_frequencies(few)


_LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
_SQL_LINE_DISTINCT = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS ordinal, count(DISTINCT {c}) AS distinct_values FROM lineitem"
    for i, c in enumerate(_LINE_COLUMNS)
)


@query(f"""
WITH d AS ({_SQL_LINE_DISTINCT} UNION ALL
           SELECT 'ship_class', 11, count(DISTINCT l_discount > 0.05e0) FROM lineitem
           UNION ALL SELECT 'quality_flag', 12, count(DISTINCT l_tax > 0.04e0) FROM lineitem),
w AS (SELECT * FROM (VALUES ('class', 0), ('label', 1), ('target', 2), ('churn', 3), ('failure', 4),
      ('quality', 5), ('severity', 6), ('ordered', 7), ('satisfaction', 8), ('fraud', 9), ('del15', 10),
      ('y_n', 11)) AS v(word, word_rank)),
c AS (SELECT d.*, d.distinct_values <= 2 AS is_candidate,
             (SELECT min(word_rank) FROM w WHERE d.distinct_values <= 2 AND contains(lower(d.column_name), w.word))
               AS word_rank FROM d),
g AS (SELECT coalesce((SELECT ordinal FROM c WHERE word_rank IS NOT NULL ORDER BY word_rank, ordinal LIMIT 1),
                      (SELECT max(ordinal) FROM c)) AS guess)
SELECT column_name, ordinal::INTEGER AS ordinal, distinct_values, is_candidate, word_rank::INTEGER AS word_rank,
       ordinal = guess AS is_guess
FROM c, g
""")
def target_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of at most two values, and the one that looks like the target."""
    lines = table(spark, sf_dir, "lineitem").withColumns(
        {"ship_class": F.col("l_discount") > 0.05, "quality_flag": F.col("l_tax") > 0.04}
    )
    counted = frequencies.value_frequencies(lines)
    return frequencies.guess_target(frequencies.distinct_counts(counted))


_SQL_LINE_FEW = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS ordinal, count(DISTINCT coalesce(trim({c}::VARCHAR), '')) AS n, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high FROM lines"
    for i, c in enumerate([*_LINE_COLUMNS, "ship_class", "quality_flag"])
)


@query(f"""
WITH lines AS (SELECT *, l_discount > 0.05e0 AS ship_class, CASE WHEN l_linenumber > 3 THEN l_tax >= 0 END AS quality_flag FROM lineitem),
d AS ({_SQL_LINE_FEW}),
c AS (SELECT *, n <= 2 AS is_candidate, CASE WHEN n <= 2 AND column_name = 'ship_class' THEN 0 WHEN n <= 2 AND column_name = 'quality_flag' THEN 5 END AS word_rank FROM d),
g AS (SELECT coalesce((SELECT ordinal FROM c WHERE word_rank IS NOT NULL ORDER BY word_rank, ordinal LIMIT 1), (SELECT max(ordinal) FROM c)) AS guess)
SELECT column_name, ordinal::INTEGER AS ordinal, least(n, 3) AS distinct_values, is_candidate, word_rank::INTEGER AS word_rank, ordinal = guess AS is_guess,
       CASE WHEN is_candidate THEN CASE WHEN low = high THEN CASE WHEN n = 2 THEN '~' ELSE '' END || low ELSE low || '~' || high END END AS "values"
FROM c, g
""")
def target_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of at most two values from two scans without a shuffled row per value, and the guess."""
    lines = table(spark, sf_dir, "lineitem").withColumns(
        {"ship_class": F.col("l_discount") > 0.05, "quality_flag": F.when(F.col("l_linenumber") > 3, F.col("l_tax") >= 0)}
    )
    return find_target(lines).withColumn("values", F.array_join("values", "~"))


# --- classes, splits, balance --------------------------------------------------------------


@query("""
SELECT quality AS label, count(*) AS cnt FROM documents JOIN labels USING (doc_id) GROUP BY quality
""")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per class."""
    return balance.class_histogram(labeled_documents(spark, sf_dir), "quality").withColumnRenamed("quality", "label")


@query("""
WITH h AS (SELECT 'quality' AS target, quality::VARCHAR AS label, count(*) AS cnt
           FROM documents JOIN labels USING (doc_id) GROUP BY ALL
           UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY ALL)
SELECT target, count(*) AS classes, max(cnt) AS max_cnt, min(cnt) AS min_cnt,
       round(max(cnt) / min(cnt), 6) AS ratio, max(cnt) / min(cnt) > 2 AS oversample
FROM h GROUP BY target
""")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of classes, largest over smallest class."""
    quality = balance.class_histogram(labeled_documents(spark, sf_dir), "quality")
    status = balance.class_histogram(table(spark, sf_dir, "orders"), "o_orderstatus")
    both = [
        balance.imbalance(h).withColumns({"target": F.lit(name), "ratio": F.round("ratio", 6)})
        for name, h in (("quality", quality), ("status", status))
    ]
    return both[0].unionByName(both[1])


@query("""
SELECT 'embeddings' AS source, count(DISTINCT label) AS classes FROM embeddings
UNION ALL SELECT 'orders', count(DISTINCT o_orderstatus) FROM orders
""")
def class_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels."""
    vectors = balance.class_count(table(spark, sf_dir, "embeddings")).withColumn("source", F.lit("embeddings"))
    orders = balance.class_count(table(spark, sf_dir, "orders"), "o_orderstatus")
    return vectors.unionByName(orders.withColumn("source", F.lit("orders")))


_SQL_BUCKET = f"(('0x' || substr(md5({SQL_LINE_KEY}), 1, 8))::BIGINT % 100)"


@query(f"""
SELECT CASE WHEN {_SQL_BUCKET} < 60 THEN 'train' WHEN {_SQL_BUCKET} < 80 THEN 'tune' ELSE 'test' END AS part,
       CASE WHEN {_SQL_BUCKET} < 80 THEN 'train' ELSE 'test' END AS two_parts,
       count(*) AS n_rows, sum(l_orderkey)::BIGINT AS sum_key
FROM lineitem GROUP BY ALL
""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by row key."""
    lines = balance.hash_split(table(spark, sf_dir, "lineitem"), LINE_KEY, name="two_parts")
    three = (("train", 60), ("tune", 20), ("test", 20))
    return balance.hash_split(lines, LINE_KEY, three).groupBy("part", "two_parts").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("sum_key")
    )


@query("""
WITH h AS (SELECT quality, count(*) AS cnt FROM labels GROUP BY quality),
r AS (SELECT quality, CASE WHEN cnt < (SELECT max(cnt) FROM h)
             THEN least((SELECT max(cnt) FROM h) / cnt, 10e0) ELSE 1e0 END AS rate FROM h),
c AS (SELECT l.*, (floor(rate) + (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296e0
             < rate - floor(rate))::INTEGER)::BIGINT AS copies FROM labels l JOIN r USING (quality))
SELECT doc_id, quality FROM c, range(1, 1000) AS n(i) WHERE i <= copies
""")
def oversample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the smaller class repeated up to the larger one."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return balance.oversample(labels, ["doc_id"], "quality")


@query("""
WITH RECURSIVE h AS (SELECT quality, count(*) AS cnt FROM labels GROUP BY quality),
r AS (SELECT quality, least((SELECT max(cnt) FROM h) / cnt, 10e0) AS rate FROM h WHERE cnt < (SELECT max(cnt) FROM h)),
p AS (SELECT quality, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS upto FROM r
      UNION ALL SELECT quality, rate, k + 1, p * rate / (k + 1), upto + p * rate / (k + 1) FROM p WHERE k < 60),
u AS (SELECT doc_id, quality, ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296e0 AS u FROM labels),
drawn AS (SELECT doc_id, u.quality, count(upto) AS copies FROM u JOIN p ON p.quality = u.quality AND upto <= u GROUP BY ALL)
SELECT doc_id, quality FROM drawn, range(1, 1000) AS n(i) WHERE i <= copies
UNION ALL SELECT doc_id, quality FROM labels WHERE quality NOT IN (SELECT quality FROM r) OR quality IS NULL
""")
def resample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bootstrap of every class but the largest, by Poisson draws from the row key."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return balance.resample_randomly(balance.deal(labels, ["doc_id"]), ["doc_id"], "quality")


# --- indexing and scaling ------------------------------------------------------------------


def _sql_index(source: str, name: str) -> str:
    return (
        f"SELECT '{name}' AS column_name, {name}::VARCHAR AS value, count(*) AS cnt, "
        f"row_number() OVER (ORDER BY count(*) DESC, {name}::VARCHAR) - 1 AS idx FROM {source} GROUP BY {name}"
    )


@query(" UNION ALL ".join([
    _sql_index("events", "event_type"), _sql_index("events", "user_id"), _sql_index("orders", "o_custkey"),
]))
def frequency_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories numbered by falling count."""
    parts = [
        ranking.frequency_index(table(spark, sf_dir, source), name).withColumn("column_name", F.lit(name))
        for source, name in (("events", "event_type"), ("events", "user_id"), ("orders", "o_custkey"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH b AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0,
                  max(l_extendedprice) AS p1 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round((l_quantity - q0) / (q1 - q0), 6) AS l_quantity_scaled,
       round((l_extendedprice - p0) / (p1 - p0), 6) AS l_extendedprice_scaled, 0.5e0 AS same_scaled
FROM lineitem, b
""")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: columns scaled to [0, 1]; a constant one to 0.5."""
    lines = table(spark, sf_dir, "lineitem").withColumn("same", F.lit(7))
    scaled = features.minmax_scale(lines, ["l_quantity", "l_extendedprice", "same"])
    return scaled.select(
        *LINE_KEY,
        F.round("l_quantity_scaled", 6).alias("l_quantity_scaled"),
        F.round("l_extendedprice_scaled", 6).alias("l_extendedprice_scaled"),
        "same_scaled",
    )


@query(f"""
WITH {GAPPY_SQL}
SELECT l_linenumber, count(*) AS n_rows FROM gappy
WHERE l_tax IS NOT NULL AND NOT isnan(l_discount) AND is_large IS NOT NULL GROUP BY l_linenumber
""")
def numeric_fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose numeric features are all there, as vectors."""
    lines = gappy_lines(spark, sf_dir)
    names = columns.feature_names(lines, Scene("line_return", "l_returnflag"), key=LINE_KEY)
    vectors = features.numeric_vector(lines, names)
    return vectors.filter(F.col("features").isNotNull()).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
