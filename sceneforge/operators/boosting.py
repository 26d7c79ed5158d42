"""Boosted trees with L1 and L2 terms, for two classes and more.

Each round adds a tree (one per class beyond two classes) that lowers the logistic
or softmax loss, seen through its first and second derivatives. Features are cut
into bins once and the binned rows are written out in blocks of as many rows as an
Arrow batch has, one array for each part of a block. A level of all trees of a round
is one job: tasks add up derivatives by (class, node, feature, bin) over their rows,
the sums meet by feature, and each feature gives its best cut per node; the driver
sees a row per (class, node, feature) and picks. No row moves between tasks. Where all binned
rows fit in one task (``TASK_BYTES``), the same steps run there one after another, as one job.

A row carries its margins from round to round; that table is kept in memory and
written out every few rounds, so a lost executor costs those rounds only for its part.
Which rows and features a tree sees follows from hashes of row number and round.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from sceneforge.session import write_out

# A split must gain more than this, and each side must weigh this much.
LEAST_GAIN = 1e-6
LEAST_WEIGHT = 1.0

# Bytes of binned rows a task should have at least, and rounds between two written tables.
TASK_BYTES = 8 << 20
WRITE_EVERY = 20

_BEST = "class int, node int, feature int, gain double, bin int, g_left double, h_left double, g_right double, h_right double"


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    l1: float = 0.5
    l2: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 128
    seed: int = 42


class Tree:
    """A tree as arrays; the children of node i are 2 i + 1 and 2 i + 2, a leaf has feature -1."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full(size, -1, np.int32)
        self.bin = np.zeros(size, np.int32)
        self.cut = np.zeros(size)
        self.value = np.zeros(size)
        self.gain = np.zeros(size)

    def descend(self, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Node of each row so far, for ``values`` by feature and row compared with ``cuts``."""
        node = np.zeros(values.shape[1], np.int64)
        inner = [0]
        while inner := [n for n in inner if self.feature[n] >= 0]:  # a level; one comparison a cut
            for n in inner:
                here = slice(None) if n == 0 else np.flatnonzero(node == n)
                node[here] = 2 * n + 1 + (values[self.feature[n], here] > cuts[n])
            inner = [child for n in inner for child in (2 * n + 1, 2 * n + 2)]
        return node

    def as_lists(self) -> dict:
        used = np.flatnonzero((self.feature >= 0) | (self.value != 0))
        return {"node": used.tolist(), **{k: getattr(self, k)[used].tolist() for k in ("feature", "cut", "value", "gain")}}

    @staticmethod
    def from_lists(depth: int, lists: dict) -> Tree:
        tree = Tree(depth)
        for k in ("feature", "cut", "value", "gain"):
            getattr(tree, k)[lists["node"]] = lists[k]
        return tree


def derivatives(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by each margin (one column for two classes)."""
    p = probabilities(margins)
    if margins.shape[1] == 1:
        return p[:, 1:] - (label == 1)[:, None], np.maximum(p[:, 1:] * p[:, :1], 1e-16)
    return p - (label[:, None] == np.arange(margins.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)


def probabilities(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        margins = np.concatenate((np.zeros_like(margins), margins), axis=1)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _softened(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def leaf_value(g: float, h: float, s: Settings) -> float:
    return float(-s.rate * _softened(np.float64(g), s.l1) / (h + s.l2))


def best_cuts(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """For sums by (node, bin): gain and bin of the best cut of each node, and the sums on both sides."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    score = lambda a, b: _softened(a, s.l1) ** 2 / (b + s.l2)
    gain = 0.5 * (score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h))
    gain = np.where((left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT), gain, -np.inf)
    at = gain.argmax(axis=1)
    rows = np.arange(len(g))
    return gain[rows, at], at, left_g[rows, at], left_h[rows, at], right_g[rows, at], right_h[rows, at]


def sampled(row: np.ndarray, number: int, share: float, seed: int) -> np.ndarray:
    """Whether each row is drawn for a round, by a hash of both."""
    x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((number * 0xD1B54A32D192ED03 + seed) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(share, 1) * (2**64 - 2048))


def chosen_features(features: int, number: int, trees: int, s: Settings) -> list[np.ndarray]:
    """Features each tree of a round may use."""
    draw = np.random.default_rng([s.seed, number])
    return [np.sort(draw.permutation(features)[: max(1, math.floor(features * s.columns + 0.5))]) for _ in range(trees)]


def _blocks(batches: Iterable[pa.RecordBatch], features: int, trees: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row numbers, labels, bins (by feature and row) and margins of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            row, label, bins, margins = (np.frombuffer(batch[c][k].as_buffer(), kind) for c, kind in _KINDS.items())
            yield row, label, bins.reshape(features, -1), margins.reshape(-1, trees)


def _state_row(*arrays: np.ndarray) -> pa.RecordBatch:
    """A block as a row; its arrays are held one after the other."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for x, kind in zip(arrays, _KINDS.values())], list(_KINDS))


def _histograms(s: Settings, features: int, number: int, trees: list[Tree], open_nodes: list[list[int]]) -> Callable:
    """Sums of derivatives of a task's rows by bin, a row per (class, node, feature)."""

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        allowed = chosen_features(features, number, len(trees), s)
        for row, label, bins, margins in _blocks(batches, features, len(trees)):
            drawn = np.flatnonzero(sampled(row, number, s.rows, s.seed))
            if not len(drawn):
                continue
            bins = np.take(bins, drawn, axis=1)
            g, h = derivatives(margins[drawn], label[drawn])
            for k, tree in enumerate(trees):
                if not open_nodes[k]:
                    continue
                place = np.full(len(tree.feature), -1)
                place[open_nodes[k]] = np.arange(len(open_nodes[k]))
                at = place[tree.descend(bins, tree.bin)]
                on = np.flatnonzero(at >= 0)
                slots, size = at[on] * s.bins, len(open_nodes[k]) * s.bins
                weights = [w[on, k] for w in (g, h)]
                for f in allowed[k].tolist():
                    slot = slots + bins[f, on]
                    both = np.stack([np.bincount(slot, w, size) for w in weights])
                    sums[k, f] = sums[k, f] + both if (k, f) in sums else both
        for (k, f), both in sums.items():
            parts = both.reshape(2, -1, s.bins).transpose(1, 0, 2)
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * n, pa.int32()), pa.array(open_nodes[k], pa.int32()), pa.array([f] * n, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["class", "node", "feature", "sums"])

    return add_up


def _best_of_features(s: Settings) -> Callable:
    """The best cut per (class, node, feature), from all tasks' sums; those come sorted, so sums do not depend on chance."""

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for k, node, f, data in zip(*(batch[c].to_pylist() for c in ("class", "node", "feature", "sums"))):
                both = np.frombuffer(data).reshape(2, -1)
                sums[k, node, f] = sums[k, node, f] + both if (k, node, f) in sums else both
        if sums:
            whole = np.stack(list(sums.values()))
            gain, at, *sides = best_cuts(whole[:, 0], whole[:, 1], s)
            keys = np.array(list(sums), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(keys[:, i]) for i in range(3)), pa.array(gain), pa.array(at.astype(np.int32)), *map(pa.array, sides)],
                [c.split()[0] for c in _BEST.split(", ")])

    return choose


def _add_trees(features: int, trees: list[Tree]) -> Callable:
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, label, bins, margins in _blocks(batches, features, len(trees)):
            more = np.stack([t.value[t.descend(bins, t.bin)] for t in trees], axis=1)
            yield _state_row(row, label, bins, margins + more)

    return add


def quantile_cuts(df: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Upper ends of all bins of each feature but the last, at equal shares of the rows (approximately)."""
    slots = df.select(*[F.col("x")[i].alias(f"f{i}") for i in range(features)])
    shares = [k / bins for k in range(1, bins)]
    found = []
    for at in range(0, features, 64):
        names = [f"f{i}" for i in range(at, min(at + 64, features))]
        found += slots.approxQuantile(names, shares, 1 / (8 * bins))
    return [np.unique(np.array(f, dtype=np.float64)) for f in found]


def _binned(cuts: list[np.ndarray], trees: int) -> Callable:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
            yield _state_row(batch["row"].to_numpy(), batch["label"].to_numpy(), bins, np.zeros((len(x), trees)))

    return cut


_KINDS = {"row": np.int64, "label": np.int32, "bins": np.uint8, "margins": np.float64}
_STATE = ", ".join(f"{name} binary" for name in _KINDS)


def fit_trees(df: DataFrame, classes: int, s: Settings) -> list[list[Tree]]:
    """Trees of all rounds from rows of ``x`` (array of numbers) and ``label``."""
    numbered = write_out(df.select("x", F.col("label").cast("int").alias("label")).withColumn("row", F.monotonically_increasing_id()), "boost-rows")
    first = numbered.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("features")).first()
    if not first.n:
        raise ValueError("no rows to learn from")
    features, width = first.features, 1 if classes <= 2 else classes
    cuts = quantile_cuts(numbered, features, s.bins)
    binned = numbered.mapInArrow(_binned(cuts, width), _STATE)
    state = write_out(binned, "boost-state")
    tasks = math.ceil(first.n * (features + 8 * width) / TASK_BYTES)
    if tasks <= 1:
        found = state.coalesce(1).mapInArrow(_all_rounds(features, width, cuts, s), "number int, class int, tree string").collect()
        trees = {(r.number, r["class"]): Tree.from_lists(s.depth, json.loads(r.tree)) for r in found}
        return [[trees[number, k] for k in range(width)] for number in range(len(trees) // width)]
    state = state.coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    rounds, older = [], []
    try:
        for number in range(s.rounds):
            trees = _one_round(lambda add_up, choose: _best_by_job(state, add_up, choose), features, width, number, cuts, s)
            rounds.append(trees)
            for done in older:
                done.unpersist()
            if number + 1 == s.rounds:
                break
            grown = state.mapInArrow(_add_trees(features, trees), _STATE)
            if (number + 1) % WRITE_EVERY == 0:
                grown = write_out(grown, "boost-state")
            older, state = [state], grown.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        for done in (*older, state):
            done.unpersist()
    return rounds


def _best_by_job(state: DataFrame, add_up: Callable, choose: Callable) -> list[dict]:
    sums = state.mapInArrow(add_up, "class int, node int, feature int, sums binary").withColumn("part", F.spark_partition_id())
    sums = sums.repartition("feature").sortWithinPartitions("feature", "class", "node", "part").select("class", "node", "feature", "sums")
    return [r.asDict() for r in sums.mapInArrow(choose, _BEST).collect()]


def _all_rounds(features: int, width: int, cuts: list[np.ndarray], s: Settings) -> Callable:
    """All rounds over the rows of one task; a row per tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        for number in range(s.rounds):
            best = lambda add_up, choose: [r for batch in choose(add_up(held)) for r in batch.to_pylist()]  # noqa: B023, E731
            trees = _one_round(best, features, width, number, cuts, s)
            texts = [json.dumps(t.as_lists()) for t in trees]
            yield pa.RecordBatch.from_arrays([pa.array([number] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(texts)], ["number", "class", "tree"])
            held = list(_add_trees(features, trees)(held))

    return run


def _one_round(find: Callable, features: int, width: int, number: int, cuts: list[np.ndarray], s: Settings) -> list[Tree]:
    """Grow the trees of a round level by level; ``find`` runs the two steps that give the best cuts."""
    trees = [Tree(s.depth) for _ in range(width)]
    open_nodes = [[0] for _ in range(width)]
    for _ in range(s.depth):
        if not any(open_nodes):
            break
        best: dict[tuple[int, int], dict] = {}
        for r in find(_histograms(s, features, number, trees, open_nodes), _best_of_features(s)):
            key = (r["class"], r["node"])
            if key not in best or (r["gain"], -r["feature"]) > (best[key]["gain"], -best[key]["feature"]):
                best[key] = r
        for nodes in open_nodes:
            nodes.clear()
        for (k, node), r in sorted(best.items()):
            tree = trees[k]
            if node == 0:
                tree.value[0] = leaf_value(r["g_left"] + r["g_right"], r["h_left"] + r["h_right"], s)
            if not r["gain"] > LEAST_GAIN:
                continue
            tree.feature[node], tree.bin[node], tree.gain[node], tree.value[node] = r["feature"], r["bin"], r["gain"], 0.0
            tree.cut[node] = cuts[r["feature"]][r["bin"]]
            for child, side in ((2 * node + 1, "left"), (2 * node + 2, "right")):
                tree.value[child] = leaf_value(r[f"g_{side}"], r[f"h_{side}"], s)
                open_nodes[k].append(child)
    return trees


class RegularizedBoosting(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of boosted trees; ``settings`` are those of ``Settings``."""

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    settings = Param(Params._dummy(), "settings", "settings as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", classes: int = 2, settings: str = "{}"):
        super().__init__()
        self._setDefault(classes=2, settings="{}")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RegularizedBoostingModel:
        s = Settings(**json.loads(self.getOrDefault(self.settings)))
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).alias("label"))
        classes = self.getOrDefault(self.classes)
        rounds = fit_trees(rows, classes, s)
        features = dataset.select(F.size(vector_to_array(self.getFeaturesCol())).alias("n")).first().n
        model = RegularizedBoostingModel(featuresCol=self.getFeaturesCol())
        text = json.dumps({"depth": s.depth, "features": features, "classes": classes, "rounds": [[t.as_lists() for t in trees] for trees in rounds]})
        return model._set(trees=text)


class RegularizedBoostingModel(
    Model, HasFeaturesCol, HasPredictionCol, HasRawPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Trees of all rounds as JSON text; scores with one Arrow call per batch."""

    trees = Param(Params._dummy(), "trees", "trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features"):
        super().__init__()
        self._setDefault(trees="{}", predictionCol="prediction", rawPredictionCol="rawPrediction", probabilityCol="probability")
        self._set(**self._input_kwargs)

    def setPredictionCol(self, value: str) -> RegularizedBoostingModel:
        return self._set(predictionCol=value)

    def _read(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    @property
    def numRounds(self) -> int:
        return len(self._read()["rounds"])

    @property
    def featureImportances(self) -> DenseVector:
        """Gain of each feature's splits, as shares of all."""
        known = self._read()
        total = np.zeros(known["features"])
        for trees in known["rounds"]:
            for t in trees:
                feature = np.array(t["feature"], dtype=np.int64)
                np.add.at(total, feature[feature >= 0], np.array(t["gain"])[feature >= 0])
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margins = _margins(self.getOrDefault(self.trees))(vector_to_array(self.getFeaturesCol()))
        # the raw scores are the margins, for two classes half of it on each side of zero, as Spark's own boosted trees have it
        scored = dataset.withColumn(self.getRawPredictionCol(), array_to_vector(margins))
        raw = vector_to_array(f"`{self.getRawPredictionCol()}`")
        e = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        scored = scored.withColumn(self.getProbabilityCol(), array_to_vector(F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))))
        place = F.array_position(raw, F.array_max(raw)) - 1
        return scored.withColumn(self.getPredictionCol(), place.cast("double"))


def _margins(text: str) -> Callable:
    @F.pandas_udf("array<double>")
    def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = json.loads(text)
        rounds = [[Tree.from_lists(known["depth"], t) for t in trees] for trees in known["rounds"]]
        for values in batches:
            x = np.stack(values.to_numpy()).reshape(len(values), -1) if len(values) else np.zeros((0, known["features"]))
            by_feature = np.ascontiguousarray(x.T)
            total = np.zeros((len(x), 1 if known["classes"] <= 2 else known["classes"]))
            for trees in rounds:
                for k, tree in enumerate(trees):
                    total[:, k] += tree.value[tree.descend(by_feature, tree.cut)]
            if known["classes"] <= 2:
                total = np.concatenate((-total / 2, total / 2), axis=1)
            yield pd.Series(list(total))

    return margins
