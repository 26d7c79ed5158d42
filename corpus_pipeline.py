"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that its predecessor kept and returns the columns of
``documents`` (further columns pass through); the last one returns the places of
the documents left in bins. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneforge.llm import jaccard_join, language_id, packing, repeated_passages, toxicity
from sceneforge.session import write_out

ORACLE_SQL = None
"""SQL can express neither the learned stages nor packing; each stage is tested against a plain version instead."""


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 by models of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.reject_toxic(docs, toxicity.train(docs, labels))


def drop_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; texts without a letter go."""
    return language_id.reject_unclear(docs, language_id.train(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8, the one with the smallest id.

    Rows that repeat the kept id stay with it. Of a group without any id one text
    stays, and texts without words all do.
    """
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"), 5, 0.8, grouped=True)
    found = found.where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    # a group with an id has one kept id, so only those without any have a choice of keys
    kept = found.groupBy(F.coalesce("part", "key"), F.col("doc_id").alias("kept_id")).agg(F.min("key").alias("kept_key")).select("kept_id", "kept_key").distinct()
    key = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (key == kept["kept_key"]), "left_semi")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words that occur earlier; texts that lose nothing stay as they are."""
    left = repeated_passages.remove_repeats(docs, verbatim=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    for c in docs.columns:
        columns.setdefault(c, F.col("others")[c])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return left.select(*(columns[c].alias(c) for c in docs.columns))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in bins of 2,048 words, no source and no equal text twice in one."""
    return packing.pack(docs, packing.word_count(F.col("text")), F.xxhash64("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unclear_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
