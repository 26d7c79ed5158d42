"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of the rotated
vectors make balanced binary codes. The code is cut into TABLES pieces; vectors
whose pieces each have at most one bit that the other lacks meet there, which finds every
pair whose codes differ in fewer than 2 * TABLES bits. Pairs that meet are
compared by their original vectors, blockwise and in place: a bucket returns link
counts and its components, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from sceneforge.llm.common import components, group_starts, whole_groups
from sceneforge.session import write_out

SAMPLE = 20_000
"""Vectors the rotation is learned from."""
ROUNDS = 30
MAX_BITS = 64
TABLES = 6
PART = 1024
"""Members of a bucket that meet in one group; larger buckets are cut and their parts meet pairwise."""


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def learn_rotation(sample: np.ndarray) -> np.ndarray:
    """Projection to principal directions, rotated until signs fit values best (dimensions x bits)."""
    dims = sample.shape[1]
    bits = min(MAX_BITS, dims)
    if not len(sample):
        return np.eye(dims)[:, :bits]
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1][:, :bits]
    values = sample @ axes
    turn = np.linalg.qr(np.random.default_rng(7).standard_normal((bits, bits)))[0]
    for _ in range(ROUNDS):
        codes = np.where(values @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(values.T @ codes)
        turn = left @ right
    return axes @ turn


def encode(unit: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as 64-bit numbers, bit k for column k."""
    signs = (unit @ rotation >= 0).astype(np.uint64)
    return (signs << np.arange(rotation.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def pieces(bits: int, tables: int) -> list[tuple[int, int]]:
    """First bit and length of the piece of each table."""
    cuts = np.linspace(0, bits, min(tables, bits) + 1).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:])]


def _meets(one: np.ndarray, other: np.ndarray, begin: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether codes have a key of a table in common, and which one: the bits of both, when either piece has one more at most."""
    mask = np.uint64((1 << length) - 1)
    one, other = (one >> np.uint64(begin)) & mask, (other >> np.uint64(begin)) & mask
    return (np.bitwise_count(one & ~other) <= 1) & (np.bitwise_count(other & ~one) <= 1), one & other


def _links(own: pa.Table, rotation_bits: int, tables: int, threshold: float, table: int, key: int, parts: tuple[int, int]) -> Iterator[tuple]:
    """(class ids, links, local roots) of one group: pairs that meet here first, by cosine."""
    cut = pieces(rotation_bits, tables)
    codes = own["code"].to_numpy().view(np.uint64)
    ids, copies = own["class_id"].to_numpy(), own["copies"].to_numpy()
    unit = _matrix(pa.concat_arrays(own["vector"].chunks))
    part = own["part"].to_numpy()
    left = np.flatnonzero(part == parts[0])
    right = np.flatnonzero(part == parts[1])
    met = unit[left] @ unit[right].T >= threshold
    if parts[0] == parts[1]:
        met &= left[:, None] < right[None, :]
    rows, columns = np.nonzero(met)
    rows, columns = left[rows], right[columns]
    if not len(rows):
        return
    first = np.ones(len(rows), dtype=bool)
    for k in range(table):  # no earlier table has them together
        first &= ~_meets(codes[rows], codes[columns], *cut[k])[0]
    # in this table the pair meets under the bits that both pieces have
    first &= _meets(codes[rows], codes[columns], *cut[table])[1] == np.uint64(key)
    rows, columns = rows[first], columns[first]
    if not len(rows):
        return
    links = np.bincount(rows, copies[columns], len(ids)) + np.bincount(columns, copies[rows], len(ids))
    root = np.arange(len(ids))
    while True:  # smallest row reached by links
        before = root.copy()
        np.minimum.at(root, rows, root[columns])
        np.minimum.at(root, columns, root[rows])
        root = root[root]
        if (root == before).all():
            break
    some = np.flatnonzero(links)
    yield ids[some], links[some].astype(np.int64), ids[root[some]]


def near_vectors(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES) -> DataFrame:
    """Links between vectors with cosine ``threshold`` or more: vec_id, n_links, component_id, kept.

    Cosines are taken in double precision. Vectors that are null or zero, or hold
    null or non-finite components, link with nothing, nor do vectors of different
    lengths with each other. Equal vectors are one vector with copies. Repeated ids
    are separate vectors of one name; a null id joins groups but names none.
    ``n_links`` counts other rows linked directly, ``component_id`` is the smallest
    id reached by links and ``kept`` marks rows that have it. Further columns are
    not read. What is returned is exact for all pairs that meet in some table.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(usable, F.xxhash64("vector")).alias("class_id"), "vector")
    classes = rows.where("class_id IS NOT NULL").groupBy("class_id").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("vector").alias("vector"), F.first(F.size("vector")).alias("dims")
    )
    classes = write_out(classes, "vectors")
    named = rows.select("vec_id", "class_id")
    found = []
    for dims in [r.dims for r in classes.select("dims").distinct().collect()]:
        own = classes.where(F.col("dims") == dims)
        sample = own.orderBy(F.xxhash64(F.lit(1), "class_id")).limit(SAMPLE).select("vector").toArrow()["vector"]
        rotation = learn_rotation(_matrix(pa.concat_arrays(sample.chunks)))
        found.append(_meet(own, rotation, threshold, tables))
    if not found:
        links, parts = spark.createDataFrame([], "class_id long, links long"), spark.createDataFrame([], "node long, component long")
    else:
        met = found[0]
        for more in found[1:]:
            met = met.union(more)
        met = write_out(met, "links")
        links = met.groupBy("class_id").agg(F.sum("links").alias("links"))
        parts = components(met.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    whole = classes.select("class_id", "copies", "low").join(links, "class_id", "left").join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    whole = whole.select("class_id", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("part"))
    whole = write_out(whole, "parts")
    least = whole.groupBy("part").agg(F.min("low").alias("component_id"))
    whole = whole.join(least, "part").select("class_id", "n_links", "component_id")
    out = named.join(whole, "class_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class_id").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _meet(classes: DataFrame, rotation: np.ndarray, threshold: float, tables: int) -> DataFrame:
    """(class_id, links, root) for each bucket in which a class has links that it has in no earlier one."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(rotation)
    bits = rotation.shape[1]
    cut = pieces(bits, tables)

    @arrow_udf("long")
    def code_of(vectors: pa.Array) -> pa.Array:
        return pa.array(encode(_matrix(vectors), shared.value).view(np.int64))

    coded = write_out(classes.withColumn("code", code_of("vector")).select("class_id", "copies", "code", "vector"), "codes")
    def keys_of(number: int, begin: int, length: int) -> Column:
        """Where a vector is put in a table: under its piece, and under the piece with any one bit taken away.

        Pieces that differ in one bit, or in one each way, meet under the bits that both have.
        """
        piece = F.shiftrightunsigned("code", begin).bitwiseAND(F.lit((1 << length) - 1))
        bits = F.array(*(F.lit(1 << b).cast("long") for b in range(length)))
        less = F.transform(F.filter(bits, lambda bit: piece.bitwiseAND(bit) != 0), lambda bit: piece - bit)
        return F.transform(F.concat(F.array(piece), less), lambda key: F.struct(F.lit(number).alias("table"), key.alias("key")))

    keys = [keys_of(number, begin, length) for number, (begin, length) in enumerate(cut)]
    placed = coded.select("class_id", "code", F.explode(F.concat(*keys)).alias("at")).select("class_id", "code", "at.table", "at.key")
    sizes = placed.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
    placed = placed.join(sizes, ["table", "key"])
    parts = F.ceil(F.col("size") / PART).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "class_id"), parts).cast("int")
    placed = placed.select("class_id", "table", "key", own.alias("part"), parts.alias("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("part"), o).alias("low"), F.greatest(F.col("part"), o).alias("high")))
    placed = placed.select("class_id", "table", "key", "part", F.explode(pairs).alias("met")).select("class_id", "table", "key", "part", "met.low", "met.high")
    grouped = placed.join(coded, "class_id")
    order = ["table", "key", "low", "high"]
    grouped = grouped.repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, order):
            begins = group_starts(whole, order)
            at = [whole[c].to_numpy()[begins].tolist() for c in order]
            for begin, end, number, key, low, high in zip(begins, np.append(begins[1:], whole.num_rows), *at):
                if end - begin > 1:
                    for ids, links, roots in _links(whole.slice(begin, end - begin), bits, tables, threshold, number, key, (low, high)):
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(roots)], ["class_id", "links", "root"])

    return grouped.mapInArrow(run, "class_id long, links long, root long")
