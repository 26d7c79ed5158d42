"""The given tables, and the scored and edited views of them that several queries use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sceneforge.functions import flag, sigmoid

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SQL_LINE_KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

# Literals of the fixed scorers: intercept, weight of l_quantity, weight of l_discount.
SCORERS = {
    "random_forest": (-0.7, 0.02, 4.0),
    "gbdt": (-0.5, 0.01, 6.0),
    "xgboost": (-0.9, 0.03, 1.0),
    "naive_bayes": (0.3, -0.01, -2.0),
}
NAMES = {0: "Returned or open", 1: "Neither"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_score(algo: str) -> Column:
    base, quantity, discount = SCORERS[algo]
    return F.lit(base) + F.lit(quantity) * F.col("l_quantity") + F.lit(discount) * F.col("l_discount")


def sql_raw_score(algo: str) -> str:
    base, quantity, discount = SCORERS[algo]
    return f"(({base}e0 + {quantity}e0 * l_quantity) + {discount}e0 * l_discount)"


def scored_lines(spark: SparkSession, sf_dir: str, algo: str = "random_forest") -> DataFrame:
    """Lineitem scored by a fixed scorer: a logistic expression with literal weights."""
    scored = table(spark, sf_dir, "lineitem").withColumns(
        {"label": flag(F.col("l_returnflag") == "N").cast("double"), "raw1": raw_score(algo)}
    )
    scored = scored.withColumn("p1", sigmoid(F.col("raw1")))
    return scored.withColumn("prediction", F.when(F.col("p1") >= 0.5, 1.0).otherwise(0.0))


def sql_scored_lines(algo: str = "random_forest") -> str:
    return f"""scored AS (
        SELECT *, CASE WHEN p1 >= 0.5e0 THEN 1 ELSE 0 END AS prediction
        FROM (SELECT *, 1e0 / (1e0 + exp(-raw1)) AS p1
              FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS label,
                           {sql_raw_score(algo)} AS raw1
                    FROM lineitem))
    )"""


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with values missing: tax 0, every third line's flag, NaN discounts on fifth lines."""
    third, fifth = F.col("l_linenumber") == 3, F.col("l_linenumber") == 5
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY,
        "l_quantity",
        F.when(fifth, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.when(~third, F.col("l_returnflag")).alias("l_returnflag"),
        F.when(~third, F.col("l_quantity") > 25).alias("is_large"),
        F.when(F.col("l_linenumber") == 1, F.col("l_linestatus")).alias("l_linestatus"),
    )


GAPPY_SQL = """gappy AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           CASE WHEN l_linenumber = 5 THEN 'NaN'::DOUBLE ELSE l_discount END AS l_discount,
           nullif(l_tax, 0e0) AS l_tax,
           CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS l_returnflag,
           CASE WHEN l_linenumber <> 3 THEN l_quantity > 25 END AS is_large,
           CASE WHEN l_linenumber = 1 THEN l_linestatus END AS l_linestatus
    FROM lineitem
)"""


def labeled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their quality label and a word count; the text itself stays behind."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size(F.split("text", r"\s+")).alias("n_words"),
    )
    return documents.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
