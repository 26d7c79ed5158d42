"""What the operators share: names, ids, sorted groups in tasks, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sceneforge.session import write_out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it when the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """Remainder of the crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of many whole groups from a partition that is sorted by ``keys`` (none of them null).

    Rows of one group never come in two tables, so a task holds one batch and one group at most.
    """
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        begins = group_starts(table, keys)
        if kept and all(kept[-1][key][-1] == table[key][0] for key in keys):
            if len(begins) == 1:  # still the same group
                kept.append(table)
                continue
            kept.append(table.slice(0, begins[1]))
            table = table.slice(begins[1])
            begins = begins[1:] - begins[1]
        if kept:
            yield pa.concat_tables(kept).combine_chunks()
        if len(begins) > 1:
            yield table.slice(0, begins[-1]).combine_chunks()
        kept = [table.slice(begins[-1])]
    if kept:
        yield pa.concat_tables(kept).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal ``keys`` begin in a sorted table."""
    fresh = np.zeros(table.num_rows, dtype=bool)
    fresh[:1] = True
    for key in keys:
        values = table[key].to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(fresh)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row per node with the smallest node it reaches.

    Each round every node moves to the neighbour that comes first in a hashed
    order, and the graph shrinks to the nodes moved to. Rounds are logarithmic in
    the length of the longest chain; each is written to the shared folder, so
    that nothing is computed twice. Edges with a null end are left out.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").where("a <> b").distinct()
    edges = write_out(edges, "edges")
    moves = []
    while not edges.isEmpty():
        salt = F.lit(len(moves))
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(salt, c).alias("h"), F.col(c).alias("node"))
        move = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order("b")), F.first(order("a")))["node"].alias("to"))
        move = write_out(move, "moves")
        moves.append(move)
        step = (
            edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        edges = write_out(step, "edges")
    if not moves:
        return spark.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("a").alias("component")).schema)
    found = moves[0].withColumnRenamed("to", "root")
    for move in moves[1:]:
        later = move.select(F.col("node").alias("root"), F.col("to").alias("next"))
        found = found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = write_out(found, "roots")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
