"""N-gram Jaccard join by prefixes under several global token orders.

Two texts link when the Jaccard similarity of their sets of word n-grams
reaches a threshold t. A set of n shingles has to share at least
min(SHARED, ceil(t * n)) tokens with any partner inside the prefix of
n - ceil(t * n) + SHARED tokens, under every global order of tokens. Candidates
come from shared prefix tokens under the first order (rare shingles first), must
share prefix tokens under the other orders too, and are then verified exactly.

Equal sets are one set with one id. The first round verifies one candidate a set,
which joins most groups of near copies; the second takes all candidates that lie
in different components. Tokens that many sets share make no pairs: sets that long
lists hold together are dealt into blocks, and each two blocks return the components
of their links. So no link between components is missed and no group is expanded
into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneforge.llm import words
from sceneforge.llm.common import components, group_starts, whole_groups
from sceneforge.session import write_out

SHARED = 3
"""Tokens two prefixes must share."""
SKETCH = 1 << 22
"""Counters for the document frequency of shingles; they only shape the first order."""
HEAVY = 1 << 16
"""Largest counters that one task reports."""
LONG_LIST = 256
"""Sets that share a token beyond which they are compared in blocks, not pair by pair."""
PART = 1024
"""Sets a block has on either side."""
FILTER_BITS = 26
"""2 to this many bits tell which documents a later pass may skip; others are found exactly by a join."""
_SALTS = tuple(np.uint64(s) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))


def _order(keys: np.ndarray, owner: np.ndarray, repeated: bool = False) -> np.ndarray:
    """The order by owner, then key, then place. ``repeated``: equal keys of one owner may come in any order.

    One sort of numbers that begin with the owner and go on with the key's first bits;
    where it leaves a choice that went wrong, the slower sort by two keys.
    """
    bits = np.uint64(int(owner.max(initial=0)).bit_length())
    packed = (owner.astype(np.uint64) << (np.uint64(64) - bits) | keys >> bits) if bits else keys
    order = np.argsort(packed)
    packed, sorted_keys = packed[order], keys[order]
    tied = np.flatnonzero(packed[1:] == packed[:-1])
    before, after = sorted_keys[tied], sorted_keys[tied + 1]
    if (before > after).any() or (not repeated and (before == after).any()):
        return np.lexsort((keys, owner))
    return order


class _Sets:
    """The distinct shingles of each text of a block: ``hashes[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, block: words.Block, width: int):
        hashes, index = block.runs(width)
        owner = block.text_of_word()[index]
        lengths = np.diff(block.bounds)
        for k in range(1, width):  # fewer words: all of them are the one shingle
            short = np.flatnonzero(lengths == k)
            total = np.zeros(len(short), dtype=np.uint64)
            for j in range(k):
                total = words.mix(total + block.hashes[block.bounds[short] + j])
            hashes = np.concatenate((hashes, words.mix(total + np.uint64(k))))
            owner = np.concatenate((owner, short))
        order = _order(hashes, owner, repeated=True)
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = hashes[fresh], owner[fresh]
        self.bounds = np.searchsorted(self.owner, np.arange(block.texts() + 1))
        self.sizes = np.diff(self.bounds)

    def ids(self) -> np.ndarray:
        """A hash of each set; 0 for an empty one."""
        found = np.zeros(len(self.sizes), dtype=np.uint64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            sums = np.add.reduceat(words.mix(self.hashes ^ _SALTS[0]), self.bounds[some])
            found[some] = words.mix(sums + self.sizes[some].astype(np.uint64))
        return found

    def prefixes(self, keys: np.ndarray, threshold: Fraction, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the prefixes of the texts marked by ``of`` under the order of ``keys``, and their lengths."""
        n = self.sizes
        needed = -(-(n * threshold.numerator) // threshold.denominator)
        length = np.minimum(n, n - needed + SHARED) * of
        order = _order(keys, self.owner)
        rank = np.arange(len(order)) - np.repeat(self.bounds[:-1], n)
        return self.hashes[order][rank < np.repeat(length, n)], length


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, _Sets]]:
    for block in words.blocks(batch.column("text"), fold=True):
        yield block.first, _Sets(block, width)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(words.signed(flat)))


def _row_key() -> Column:
    """The id of a row, or a hash of its text where it has none; never null."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def _measure(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """Per text its row key, its set's id and size, and estimated document frequencies by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "n", "set_id", "bucket", "seen"]
        seen = np.zeros(SKETCH, dtype=np.uint32)  # of one task's texts
        for batch in batches:
            for first, sets in _blocks(batch, width):
                np.add.at(seen, _bucket(sets.hashes), np.uint32(1))
                count, empty = len(sets.sizes), sets.sizes == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, count), batch.column("key").slice(first, count), pa.array(sets.sizes.astype(np.int64)),
                    pa.array(words.signed(sets.ids()), mask=empty), pa.nulls(count, pa.int32()), pa.nulls(count, pa.int64()),
                ], names)
        top = np.argpartition(seen, -HEAVY)[-HEAVY:]
        top = top[seen[top] > 1].astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            *(pa.nulls(len(top), pa.int64()) for _ in range(4)), pa.array(top), pa.array(seen[top].astype(np.int64)),
        ], names)

    rows = write_out(docs.withColumn("key", _row_key()).mapInArrow(run, "doc_id long, key long, n long, set_id long, bucket int, seen long"), "sets")
    found = rows.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("seen").alias("seen")).toArrow()
    frequency = np.zeros(SKETCH, dtype=np.int64)
    frequency[found["bucket"].to_numpy()] = found["seen"].to_numpy()
    return rows.where("bucket IS NULL").select("doc_id", "key", "n", "set_id"), np.minimum(frequency, 65535).astype(np.uint16)


def _postings(docs: DataFrame, width: int, threshold: Fraction, frequency: np.ndarray) -> DataFrame:
    """(token, set_id) for the prefixes under the first order, for tokens that several sets share."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: set[int] = set()
            for _, sets in _blocks(batch, width):
                ids = sets.ids()
                wanted = np.zeros(len(ids), dtype=bool)
                wanted[np.unique(ids, return_index=True)[1]] = True
                wanted &= np.fromiter((i not in known for i in ids.tolist()), bool, len(ids))
                known.update(ids[wanted].tolist())
                rare_first = shared.value[_bucket(sets.hashes)].astype(np.uint64) << np.uint64(48)
                keys = rare_first | (words.mix(sets.hashes ^ _SALTS[1]) >> np.uint64(16))
                tokens, lengths = sets.prefixes(keys, threshold, wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.signed(tokens)), pa.array(words.signed(np.repeat(ids, lengths)))], ["token", "set_id"]
                )

    rows = docs.mapInArrow(run, "token long, set_id long")
    same = Window.partitionBy("token")
    bounds = rows.withColumns({"low": F.min("set_id").over(same), "high": F.max("set_id").over(same)})
    return bounds.where("low <> high").select("token", "set_id").distinct()


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each id's hash; fixed size."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("place")
    bits = ids.select(place).selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, CAST(place & 63 AS INT)) AS bit")
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bitmap


def _members(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Sorted shingles of the wanted sets (set_id, id: the key of a row that has it), and of a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            some = np.flatnonzero((shared.value[place >> 6] >> (place & 63)) & 1)
            batch = batch.take(pa.array(some))
            for first, sets in _blocks(batch, width):
                members = pa.RecordBatch.from_arrays([pa.array(words.signed(sets.ids())), _lists(sets.hashes, sets.sizes)], ["set_id", "shingles"])
                yield members.take(pa.array(np.sort(np.unique(sets.ids(), return_index=True)[1])))  # rows with one key repeat their set

    placed = docs.select("text", F.pmod(F.xxhash64(_row_key()), F.lit(1 << FILTER_BITS)).alias("place"))
    return placed.mapInArrow(run, "set_id long, shingles array<long>").where(F.size("shingles") > 0)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""
    pairs = write_out(pairs, "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = write_out(named.join(reps, "set_id").select("set_id", F.col("key").alias("id")), "wanted")
    # the sides grow with the input: neither is ever broadcast
    members = write_out(_members(docs, wanted, width), "members").hint("merge")
    left, right = (members.select([F.col(c).alias(c + end) for c in members.columns]) for end in ("_a", "_b"))
    both = pairs.hint("merge").join(left, F.col("a") == F.col("set_id_a")).join(right, F.col("b") == F.col("set_id_b"))

    def prefix(own: str) -> Column:
        size = F.size(own)
        needed = F.ceil(size * threshold.numerator / F.lit(threshold.denominator))
        return F.least(size, size - needed + 1).cast("int")

    # the second order goes by hash, the third by falling hash
    second = [F.slice(c, F.lit(1), prefix(c)) for c in ("shingles_a", "shingles_b")]
    third = [F.slice(c, F.size(c) - prefix(c) + 1, prefix(c)) for c in ("shingles_a", "shingles_b")]
    both = both.where(F.arrays_overlap(*second) & F.arrays_overlap(*third))
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return write_out(both.where(common * threshold.denominator >= union * threshold.numerator).select("a", "b"), "links")


def _block_roots(sets: pa.Table, low: int, high: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Sets with links between two blocks (or within one), and a set that stands for those they reach here."""
    lists = pa.concat_arrays(sets["shingles"].chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, token, counts = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = counts[token] > 1
    row, token = row[several], (np.cumsum(counts > 1) - 1)[token[several]]
    part = sets["part"].to_numpy()
    left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    step = 1024
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        some = slice(*np.searchsorted(token, (first, first + step)))
        has = np.zeros((len(sizes), step), dtype=np.float32)
        has[row[some], token[some] - first] = 1
        common += has[left] @ has[right].T
    shared = np.rint(common).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    a, b = np.nonzero((shared > 0) & (shared * threshold.denominator >= union * threshold.numerator))
    a, b = left[a], right[b]
    root = np.arange(len(sizes))
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    ids, some = sets["set_id"].to_numpy(), np.flatnonzero(root != np.arange(len(sizes)))
    return ids[some], ids[root[some]]


def _links_of_long_lists(long: DataFrame, reps: DataFrame, docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """Links (a, b) that join the sets of each group of long lists (token, set_id) as all their links do."""
    together = components(long.select(F.col("set_id").alias("a"), F.xxhash64(F.lit("token"), "token").alias("b")))
    together = together.join(reps.select(F.col("set_id").alias("node"), "key"), "node").withColumnRenamed("node", "set_id")
    together = write_out(together, "together")
    sizes = together.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = write_out(_members(docs, together.select("set_id", F.col("key").alias("id")), width), "members")
    part = F.pmod(F.xxhash64(F.lit(9), "set_id"), F.col("parts")).cast("int")
    placed = together.select("set_id", "component").join(sizes, "component").withColumn("part", part)
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("low"), F.greatest("part", o).alias("high")))
    placed = placed.select("set_id", "component", "part", F.explode(other).alias("met")).select("set_id", "component", "part", "met.low", "met.high")
    order = ["component", "low", "high"]
    met = placed.join(members, "set_id").repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, order):
            begins = group_starts(table, order)
            for begin, end in zip(begins, np.append(begins[1:], table.num_rows)):
                own = table.slice(begin, end - begin)
                ids, roots = _block_roots(own, own["low"][0].as_py(), own["high"][0].as_py(), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], ["a", "b"])

    return write_out(met.mapInArrow(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", grouped: bool = False) -> DataFrame:
    """Groups of documents linked by similar word n-grams: doc_id, n_shingles, component_id.

    A word is a run of anything but space and tab to carriage return; A-Z are
    lower-cased. A text with fewer than ``width`` words has one shingle, all of
    them; a null or wordless text has none and links with nothing.
    ``component_id`` is the smallest id reachable by links. One row per input
    row: repeated rows are copies of each other, ids that come back with other
    texts are separate documents, and a null id joins groups but names none (its
    component_id is null only in a group without any id). Other columns are not read.
    ``grouped`` adds ``key``, the id or a hash of the text where there is none, and
    ``part``, the same for all rows of a group (null for a text without shingles).
    """
    limit = Fraction(str(threshold))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets, frequency = _measure(docs, width)
    reps = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.first("n").alias("n"))
    reps = write_out(reps, "reps")
    lists = _postings(docs, width, limit, frequency).join(reps.select("set_id", "n"), "set_id")
    lists = lists.withColumn("size", F.count("*").over(Window.partitionBy("token")))
    lists = write_out(lists, "lists")
    long = _links_of_long_lists(lists.where(F.col("size") > LONG_LIST), reps, docs, width, limit)
    lists = lists.where(F.col("size") <= LONG_LIST)

    needed = lambda n: F.least(F.lit(SHARED), F.ceil(n * limit.numerator / limit.denominator))
    pivots = lists.groupBy("token").agg(F.min("set_id").alias("pivot"))
    near = (
        lists.join(pivots, "token").where("set_id <> pivot").groupBy("set_id", "pivot")
        .agg(F.count("*").alias("shared"), F.first("n").alias("n"))
        .where(F.col("shared") >= needed(F.col("n")))
        .groupBy("set_id").agg(F.max(F.struct("shared", "pivot"))["pivot"].alias("pivot"))
    )
    first = _verified(near.select(F.least("set_id", "pivot").alias("a"), F.greatest("set_id", "pivot").alias("b")).distinct(), reps, docs, width, limit)

    joined = components(first.union(long)).withColumnRenamed("node", "set_id")
    labelled = lists.join(joined, "set_id", "left").select("token", "set_id", "n", F.coalesce("component", "set_id").alias("part"))
    labelled = write_out(labelled, "labelled")
    mixed = (
        labelled.groupBy("token", "part").agg(F.count("*").alias("size")).groupBy("token")
        .agg(F.max(F.struct("size", "part"))["part"].alias("major"), F.min("part").alias("low"), F.max("part").alias("high"))
        .where("low <> high").select("token", "major")
    )
    minor = labelled.join(mixed, "token").where("part <> major").select("token", "major", *(F.col(c).alias(c + "_1") for c in ("set_id", "n", "part")))
    other = labelled.select("token", *(F.col(c).alias(c + "_2") for c in ("set_id", "n", "part")))
    most, least = F.greatest("n_1", "n_2"), F.least("n_1", "n_2")
    cross = (
        minor.join(other, "token").where("part_1 <> part_2 AND (part_2 = major OR set_id_1 < set_id_2)")
        .where(least * limit.denominator >= most * limit.numerator)
        .groupBy(F.least("set_id_1", "set_id_2").alias("a"), F.greatest("set_id_1", "set_id_2").alias("b"))
        .agg(F.count("*").alias("shared"), F.max(most).alias("n"))
        .where(F.col("shared") >= needed(F.col("n"))).select("a", "b")
    )
    second = _verified(cross, reps, docs, width, limit)

    parts = components(first.union(second).union(long)).withColumnRenamed("node", "set_id")
    parts = reps.join(parts, "set_id", "left").select("set_id", "rep", F.coalesce("component", "set_id").alias("part"))
    parts = write_out(parts, "parts")
    named = parts.join(parts.groupBy("part").agg(F.min("rep").alias("component_id")), "part").select("set_id", "part", "component_id")
    return sets.join(named, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *(["key", "part"] if grouped else []),
    )
