"""Conflict-constrained best-fit packing of documents into training sequences.

Bins are kept in order of the room they have left. Each carries two bitmaps, of
the sources and of the duplicate clusters it holds. A piece goes into the tightest
bin that has room and neither its source nor its cluster: the search starts at the
successor of the piece's length and goes on until such a bin is found.

Pieces are dealt into shards of bounded size by hash; every shard packs on its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from sceneforge.llm.common import group_starts, whole_groups

CAPACITY = 2048
"""Words a bin holds."""
SHARD = 4096
"""Documents a shard has on average."""
BLOCK_BYTES = 1 << 20
"""Bytes of texts whose words are counted at once; a longer text is counted alone."""
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def _words(texts: pa.Array) -> np.ndarray:
    """Words of each text, over its bytes; null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    found, first = np.zeros(len(texts), np.int64), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
        inside = np.zeros(offsets[last] - offsets[first] + 1, bool)
        inside[:-1] = _INSIDE[data[offsets[first]:offsets[last]]]
        bounds = offsets[first:last + 1] - offsets[first]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[bounds] = inside[bounds]  # a word never goes on from the text before
        count = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
        found[first:last] = np.diff(count[bounds])
        first = last
    return found


def word_count(text: Column) -> Column:
    """Runs of anything but space and tab to carriage return; null has none."""

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(_words(texts))

    return count(text.cast("string"))


class _Bins:
    """Bins of one shard, in order of room left and number."""

    def __init__(self) -> None:
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def add(self, length: int, capacity: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece away; its bin and the place where it begins there. The bitmaps of a piece have one bit, or none."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order):
            number = self.order[at][1]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                break
            at += 1
        if at < len(self.order):
            room, number = self.order.pop(at)
        else:
            room, number = capacity, len(self.used)
            self.sources.append(0)
            self.clusters.append(0)
            self.used.append(0)
        begin = self.used[number]
        self.used[number] += length
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if room > length:  # a full bin takes nothing more
            insort(self.order, (room - length, number))
        return number, begin


def pack_shard(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and place of each piece, in the given order. Sources and clusters are numbered; -1 conflicts with nothing."""
    bins = _Bins()
    bit = lambda n: 1 << n if n >= 0 else 0
    return [bins.add(n, capacity, bit(s), bit(c)) for n, s, c in zip(lengths, sources, clusters)]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Values numbered from 0; null is -1."""
    found = column.combine_chunks().dictionary_encode()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def pack(docs: DataFrame, length: Column, cluster: Column, id_col: str = "doc_id", source_col: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """Places of documents in bins: doc_id, piece, begin, length, shard, bin, place, bin_used.

    ``length`` is cut into pieces of ``capacity`` and a rest; whole pieces have bins
    of their own. ``begin`` and ``place`` are where a piece begins in its document
    and in its bin; ``bin_used`` is what its bin holds. No bin holds two pieces of
    one source or one ``cluster``; a null of either conflicts with nothing. Pieces
    are packed from long to short, ties by id, source and cluster, so that equal
    rows differ in nothing. A null or negative length counts as 0, and a document of
    length 0 has one empty piece. Null ids are kept. Further columns are not read.
    """
    total = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), cluster.alias("cluster"), total.alias("total"))
    shards = max(1, -(-docs.count() // SHARD))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "source"), F.lit(shards)).cast("int")
    count = F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)).cast("int")
    rows = rows.select(shard.alias("shard"), "doc_id", "source", "cluster", "total", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    begin = F.col("piece").cast("long") * capacity
    rows = rows.select("shard", "doc_id", "source", "cluster", "piece", begin.alias("begin"), F.least(F.col("total") - begin, F.lit(capacity)).alias("length"))
    order = ["shard", F.desc("length"), "doc_id", "source", "cluster", "piece"]
    rows = rows.repartition("shard").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard"]):
            begins = group_starts(table, ["shard"])
            for first, last in zip(begins, np.append(begins[1:], table.num_rows)):
                own = table.slice(first, last - first)
                lengths = own["length"].to_pylist()
                placed = pack_shard(lengths, _numbers(own["source"]).tolist(), _numbers(own["cluster"]).tolist(), capacity)
                bins = np.array([b for b, _ in placed], dtype=np.int64)
                used = np.bincount(bins, lengths).astype(np.int64)
                out = own.select(["doc_id", "piece", "begin", "length", "shard"])
                out = out.append_column("bin", pa.array(bins)).append_column("place", pa.array([p for _, p in placed], pa.int64()))
                yield from out.append_column("bin_used", pa.array(used[bins])).to_batches()

    return rows.mapInArrow(run, "doc_id long, piece int, begin long, length long, shard int, bin long, place long, bin_used long")
