"""Spelling variants of frequent words, found by k-d trees over letter-count vectors.

Words are maximal runs of Latin letters (A-Z lower-cased). A word is a point: how
often it has each letter. One replaced letter takes one from a count and gives one
to another, one inserted letter adds one to a count, so near words are at an L1
distance of two or one. For each pair of lengths (n and n, n and n + 1) a range
search goes down the tree of the longer length and leaves out boxes that need
more than one letter less or more than one letter more (none less for an
insertion). What is left is verified letter by letter.

The upper part of each length's tree is fitted on at most ``SAMPLE`` words, taken
by hash; it only says where to cut, and every word is indexed and searched. Each
cell of it is one group of a shuffle: the words at home there and those whose
search reaches it. The rest of the tree is built inside the task. A cell aims at
``CELL`` words; each word goes to as many cells as its search reaches.

Null texts have no words. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sceneforge.llm.common import group_starts, whole_groups
from sceneforge.llm.lexing import all_matches, ascii_lower
from sceneforge.session import write_out

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
TYPO = 199
SAMPLE = 50_000
CELL = 4096
BUCKET = 64
_LETTERS = 26 + 64
_RUNS = r"[a-zÀ-ÿ]{%d,}"


def damaged_words(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """Runs of at least ``least`` letters of ``docs`` (doc_id, text), one row each, one letter deleted where a checksum of id and run says so."""
    runs = docs.select("doc_id", F.explode(all_matches(ascii_lower(F.col("text")), _RUNS % least)).alias("run"))
    checksum = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", checksum).select(F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("run")).alias("word"))


def frequent_words(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """Words of at least ``least`` letters that occur ``count`` times or more: word, n."""
    words = damaged_words(docs, least).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def _code_points(words: list[str]) -> np.ndarray:
    """A row of code points per word, 0 behind its end."""
    array = np.array(words, dtype=np.str_)
    return array.view(np.uint32).reshape(len(words), -1) if len(words) else np.zeros((0, 1), np.uint32)


def _counts(points: np.ndarray) -> np.ndarray:
    """How often each word has each letter: a-z, then the 64 letters beyond ASCII."""
    letter = np.where(points >= 0xC0, points - 0xC0 + 26, points - ord("a")).astype(np.int64)
    place = (np.arange(len(points))[:, None] * _LETTERS + letter)[points > 0]
    return np.bincount(place, minlength=len(points) * _LETTERS).reshape(-1, _LETTERS).astype(np.int32)


@dataclass
class Node:
    """Points with a count of ``letter`` up to ``cut`` go left. ``low`` and ``high`` bound that count in the parent's box."""

    letter: int = -1
    cut: int = 0
    low: int = 0
    high: int = 1 << 30
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1
    points: np.ndarray | None = None


def grow(counts: np.ndarray, size: float, number: Callable[[], int]) -> Node:
    """A k-d tree whose leaves hold ``size`` points at most, unless they are all equal."""

    def split(index: np.ndarray, low: np.ndarray, high: np.ndarray) -> Node:
        mine = counts[index]
        least, most = (mine.min(0), mine.max(0)) if len(index) else (np.zeros(_LETTERS), np.zeros(_LETTERS))
        if len(index) <= size or not (most > least).any():
            return Node(leaf=number(), points=index)
        shares = np.minimum((mine > np.minimum(np.median(mine, axis=0), most - 1)).mean(0), 1)
        letter = int(np.argmax(np.where(most > least, np.minimum(shares, 1 - shares), -1)))
        cut = int(min(np.median(mine[:, letter]), most[letter] - 1))
        less = mine[:, letter] <= cut
        left_high, right_low = high.copy(), low.copy()
        left_high[letter], right_low[letter] = cut, cut + 1
        return Node(letter, cut, int(low[letter]), int(high[letter]), split(index[less], low, left_high), split(index[~less], right_low, high))

    return split(np.arange(len(counts)), np.zeros(_LETTERS, np.int64), np.full(_LETTERS, 1 << 30))


def leaves_reached(node: Node, counts: np.ndarray, less: int, more: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves whose box can be reached from a point by taking ``less`` letters away and adding ``more``, and those points."""
    stack = [(node, np.arange(len(counts)), np.full(len(counts), less), np.full(len(counts), more))]
    while stack:
        node, index, less_left, more_left = stack.pop()
        if not len(index):
            continue
        if node.leaf >= 0:
            yield node, index
            continue
        here = counts[index, node.letter].astype(np.int64)
        above = less_left - (np.maximum(here - node.cut, 0) - np.maximum(here - node.high, 0))
        below = more_left - (np.maximum(node.cut + 1 - here, 0) - np.maximum(node.low - here, 0))
        left, right = above >= 0, below >= 0
        stack.append((node.left, index[left], above[left], more_left[left]))
        stack.append((node.right, index[right], less_left[right], below[right]))


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether dropping one letter of ``long`` gives ``short`` (rows of n and n + 1 code points)."""
    n = short.shape[1]
    front = np.argmax(np.concatenate((short != long[:, :n], np.ones((len(short), 1), bool)), axis=1), axis=1)
    back = np.argmax(np.concatenate((short[:, ::-1] != long[:, :0:-1], np.ones((len(short), 1), bool)), axis=1), axis=1)
    return front + back >= n


def _unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Each count as that many ones, so that a product of two rows is what the words have in common."""
    return np.concatenate([counts[:, [k]] > np.arange(most[k]) for k in np.flatnonzero(most)], axis=1).astype(np.float32)


def _near_in_cell(home: np.ndarray, guests: np.ndarray, replaced: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (guest, word at home) one edit apart, by index. Guests are as long as those at home, or one letter shorter."""
    points, queries = _counts(home), _counts(guests)
    tree = grow(points, BUCKET, lambda: 0)
    most = points.max(0)
    at_home, visiting = _unary(points, most), _unary(np.minimum(queries, most), most)
    common = home.shape[1] - 1  # letters that near words share, in both cases
    for leaf, index in leaves_reached(tree, queries, 1 if replaced else 0, 1):
        for begin in range(0, len(index), 1 << 15):
            some = index[begin:begin + (1 << 15)]
            q, p = np.nonzero(visiting[some] @ at_home[leaf.points].T == common)
            q, p = some[q], leaf.points[p]
            same = _one_replaced(guests[q], home[p]) if replaced else _one_inserted(guests[q], home[p])
            yield q[same], p[same]


_ROUTED = "length int, cell int, role int, word string, n long"
_PARTIAL = "word string, n_near long, n long, near string"


def _route(trees: dict[int, Node]) -> Callable:
    """Send each word home and to the cells its searches reach (role 0 at home, 1 equally long, 2 one letter shorter)."""
    alone = Node(leaf=0)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                counts = _counts(_code_points(words[mine].tolist()))
                home = np.zeros(len(mine), np.int64)
                for leaf, index in leaves_reached(trees.get(length, alone), counts, 0, 0):
                    home[index] = leaf.leaf
                for longer, less in ((0, 1), (1, 0)):
                    for leaf, index in leaves_reached(trees.get(length + longer, alone), counts, less, 1):
                        role = np.full(len(index), 2) if longer else np.where(home[index] == leaf.leaf, 0, 1)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(index), length + longer), pa.int32()), pa.array(np.full(len(index), leaf.leaf), pa.int32()),
                            pa.array(role, pa.int32()), pa.array(words[mine[index]], pa.string()), pa.array(n[mine[index]]),
                        ], ["length", "cell", "role", "word", "n"])

    return route


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word in a cell, how many near words it has there and the most frequent one."""
    for table in whole_groups(batches, ["length", "cell"]):
        begins = group_starts(table, ["length", "cell"])
        for begin, end in zip(begins, [*begins[1:], table.num_rows]):
            cell = table.slice(begin, end - begin)
            role = cell["role"].to_numpy()
            if not (role == 0).any():
                continue
            words, n = np.array(cell["word"].to_pylist(), dtype=np.str_), cell["n"].to_numpy()
            rank = np.empty(len(words), np.int64)  # the most frequent first, ties in code-point order
            rank[np.lexsort((words, -n))] = np.arange(len(words))
            by_rank = np.argsort(rank)
            at_home, equal, shorter = np.flatnonzero(role == 0), np.flatnonzero(role <= 1), np.flatnonzero(role == 2)
            length = int(cell["length"][0].as_py())
            home = _code_points(words[at_home].tolist())
            pairs = [(equal[q], at_home[p]) for q, p in _near_in_cell(home, _code_points(words[equal].tolist()), True)]
            if len(shorter):
                found = [(shorter[q], at_home[p]) for q, p in _near_in_cell(home, _code_points(words[shorter].tolist()), False)]
                pairs += found + [(p, q) for q, p in found]
            mine, near = (np.concatenate([pair[k] for pair in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
            if not len(mine):
                continue
            order = np.argsort(mine, kind="stable")
            mine, near = mine[order], rank[near[order]]
            first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            best = by_rank[np.minimum.reduceat(near, first)]
            yield pa.RecordBatch.from_arrays([
                pa.array(words[mine[first]].tolist(), pa.string()), pa.array(np.diff(np.append(first, len(mine))).astype(np.int64)),
                pa.array(n[best]), pa.array(words[best].tolist(), pa.string()),
            ], ["word", "n_near", "n", "near"])


def _upper_trees(words: DataFrame) -> dict[int, Node]:
    """For each length, where to cut its words into cells, from a sample of at most about ``SAMPLE`` words."""
    total = words.count()
    step = max(1, math.ceil(total / SAMPLE))
    by_length: dict[int, list[str]] = {}
    for row in words.where(F.pmod(F.xxhash64("word"), F.lit(step)) == 0).select("word").collect():
        by_length.setdefault(len(row.word), []).append(row.word)
    trees = {}
    for length, some in by_length.items():
        numbers = iter(range(len(some) + 1))
        trees[length] = grow(_counts(_code_points(sorted(some))), max(1, CELL / step), lambda: next(numbers))
    for tree in trees.values():
        _forget_points(tree)
    return trees


def _forget_points(node: Node) -> None:
    node.points = None
    for child in (node.left, node.right):
        if child:
            _forget_points(child)


def near_words(words: DataFrame) -> DataFrame:
    """For each word of ``words`` (word, n; words differ) with near ones: their number and the most frequent (ties: the first)."""
    cells = words.select("word", "n").mapInArrow(_route(_upper_trees(words)), _ROUTED)
    cells = cells.repartition("length", "cell").sortWithinPartitions("length", "cell")
    found = cells.mapInArrow(_search, _PARTIAL)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def follow(forms: DataFrame, longest: int) -> DataFrame:
    """The end of each chain of ``forms`` (word, form), of at most ``longest`` steps: word, root. Steps double each round."""
    ends = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        ends = write_out(ends, "roots")
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = ends.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return ends


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with the form each is a variant of, the root of its chain of forms, and how many near words it has.

    The form is the near word of largest n (ties: the first in code-point order) if that is at least ``ratio`` times the word's own n.
    """
    words = write_out(words, "words")
    found = words.join(near_words(words), "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    formed = write_out(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    most = formed.agg(F.max("n").alias("n")).first().n or 1
    chains = follow(formed.where("form IS NOT NULL").select("word", "form"), math.ceil(math.log(most, ratio)) + 1)
    return formed.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
