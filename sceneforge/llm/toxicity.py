"""Toxicity by class-conditional Kneser-Ney models of words and of letters.

Two models, one of toxic and one of ordinary texts, give each word its probability
after the word before it (``word_pairs``; tables that grow with the corpus), and
each letter of a word after the letters before it (``letters``; for words that no
labelled text has). What a class has seen too seldom comes from backoff counts that
both classes share. A text's score rests on differences of the two log-likelihoods:
of its words, of its letters and of its most toxic words, each divided by length,
put on one scale by a logistic line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegralType

from sceneforge.llm import letters, word_pairs
from sceneforge.llm.common import fold, free_name
from sceneforge.session import write_out

FOLDS = 5
"""Rows are dealt by crc32 of the id: 0 is held out, 4 fits the logistic line, the others the models."""
LINE_SAMPLE = 20_000
"""Labelled rows the logistic line is fitted on."""
TOP_WORDS = 3


@dataclass
class ToxicityModel:
    """Log-likelihood differences by letter n-gram, the weights of the features, and the table of words.

    ``weights`` are for letters alone, ``word_weights`` for the difference of the words as well.
    """

    ratio: np.ndarray
    weights: np.ndarray
    words: word_pairs.Table | None = None
    word_weights: np.ndarray | None = None

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Mean difference a letter, in the text, in its most toxic word, and on average in the most toxic three."""
        found = np.zeros((len(texts), 3))
        for first, some in letters.blocks(texts):
            codes, starts, words = letters.grams(some)
            if not len(codes):
                continue
            values = self.ratio[codes].astype(np.float64)
            total = np.concatenate(([0.0], np.cumsum(values)))
            lengths = np.diff(starts)
            rows = slice(first, first + len(some))
            found[rows, 0] = (total[starts[1:]] - total[starts[:-1]]) / np.maximum(lengths, 1)
            sums = np.add.reduceat(values, words) / np.diff(np.append(words, len(values)))
            owner = np.searchsorted(starts, words, side="right") - 1
            order = np.lexsort((-sums, owner))
            sums, owner = sums[order], owner[order]
            begins = np.searchsorted(owner, np.arange(len(some) + 1))
            counts = np.diff(begins)
            some_words = np.flatnonzero(counts)
            found[first + some_words, 1] = sums[begins[some_words]]
            rank = np.arange(len(sums)) - begins[owner]
            top = np.bincount(owner, np.where(rank < TOP_WORDS, sums, 0), len(some))
            found[rows, 2] = top / np.maximum(np.minimum(counts, TOP_WORDS), 1)
        return found

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability that a text is toxic; from 0 to 1 for any text."""
        line = self.features(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(line, -500, 500)))


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary()).fill_null(b"").to_pylist()


def _fit_line(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic line by Newton's method, with a small ridge."""
    spread = features.std(axis=0) + 1e-9
    x = np.hstack((features / spread, np.ones((len(features), 1))))
    ridge = np.diag([0.1] * features.shape[1] + [1e-6])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ weights)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return weights / np.append(spread, 1.0)


def _marked(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """``texts`` joined with ``marks`` (doc_id, label) by doc_id; nearly all texts stay where they are.

    Labels grow with the corpus and are never broadcast. Ids have places in bitmaps of
    fixed size; where one id is alone with one label, the bitmap of its label tells it.
    Texts of other places, few while ids are fewer than places, meet their labels in a join.
    """
    marks = marks.hint("merge")
    kinds = [df.schema["doc_id"].dataType for df in (texts, marks)]
    if kinds[0] != kinds[1] or not isinstance(kinds[0], IntegralType):
        return texts.join(marks, "doc_id")
    ids = texts.select("doc_id", F.lit(None).cast("int").alias("label")).union(marks.select("doc_id", "label")).where("doc_id IS NOT NULL")
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << word_pairs.FILTER_BITS) - 1))
    places = ids.groupBy(place.alias("hash")).agg(
        F.count("label").alias("labels"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("label").alias("label"))
    kind = F.when(F.expr("labels = 1 AND low = high"), F.col("label")).otherwise(2)
    places = write_out(places.where("labels > 0").select("hash", kind.alias("kind")), "label-places")
    bitmaps = [word_pairs.bitmap(places.where(F.col("kind") == k).select("hash")) for k in range(3)]
    hashed = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    known = texts.withColumn("label", word_pairs.may_have(hashed, bitmaps, texts.sparkSession))
    others = write_out(known.where("label = 2").drop("label").hint("merge").join(marks, "doc_id"), "marked")
    return known.where("label < 2").unionByName(others)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Models from all labelled rows outside the held-out fold.

    Rows without a label of 0 or 1 or without an id teach nothing; an id with several
    labels teaches each. The tables have a fixed size, the counts are of the whole
    corpus. Without rows of both classes every text gets the share of toxic rows (0 without any).
    """
    part = fold(F.col(id_col), FOLDS)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), part.alias("part")).where("part <> 0 AND text IS NOT NULL")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    marked = _marked(texts, marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, letters.SIZE), dtype=np.int64)
        rows = np.zeros(2, dtype=np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy()
            texts = np.array(_bytes(batch.column("text")) + [None], dtype=object)[:-1]
            for k in (0, 1):
                own = texts[label == k].tolist()
                rows[k] += len(own)
                for _, some in letters.blocks(own):
                    seen[k] += np.bincount(letters.grams(some)[0], minlength=letters.SIZE)
        grams = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_pydict({
            "gram": pa.array(np.append(grams, -1), pa.int32()),
            "ordinary": np.append(seen[0, grams], rows[0]), "toxic": np.append(seen[1, grams], rows[1]),
        })

    counts = marked.where(f"part <> {FOLDS - 1}").select("text", "label").mapInArrow(count, "gram int, ordinary long, toxic long")
    found = counts.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    gram, both = found["gram"].to_numpy(), np.stack([found["ordinary"].to_numpy(), found["toxic"].to_numpy()])
    rows = both[:, gram < 0].sum(axis=1)
    tables = np.zeros((2, letters.SIZE), dtype=np.int64)
    tables[:, gram[gram >= 0]] = both[:, gram >= 0]
    if not rows.all():
        share = rows[1] / max(1, rows.sum())
        return ToxicityModel(np.zeros(letters.SIZE, np.float32), np.array([0, 0, 0, np.log((share + 1e-9) / (1 - share + 1e-9))]))
    learned = marked.where(f"part <> {FOLDS - 1}").select("text", "label")
    model = ToxicityModel(letters.log_ratio(tables[1], tables[0]), np.zeros(4), word_pairs.learn(learned))
    plain = ToxicityModel(model.ratio, model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    @arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array(list(shared.value.features(_bytes(texts))), pa.list_(pa.float64()))

    line = marked.where(f"part = {FOLDS - 1}").orderBy(F.xxhash64(F.lit(5), "doc_id")).limit(LINE_SAMPLE)
    line = write_out(line.select("label", "text", word_pairs.text_key(F.col("text")).alias("key")), "line")
    means = model.words.means(line)
    line = line.select("key", "label", features("text").alias("features")).join(means, "key")
    line = line.select("label", "features", "mean").toArrow()
    label = line["label"].to_numpy()
    if len(np.unique(label)) < 2:  # too few rows for a line: a word ten times likelier in a toxic text each letter
        model.weights = np.array([0.0, 0.0, 1.0, -np.log(10.0)])
        model.word_weights = np.array([0.0, 0.0, 1.0, 1.0, -np.log(10.0)])
    else:
        own = np.array(line["features"].to_pylist())
        model.weights = _fit_line(own, label)
        model.word_weights = _fit_line(np.hstack((own, line["mean"].to_numpy()[:, None])), label)
    return model


def toxicity(text: Column, model: ToxicityModel, docs: DataFrame) -> Column:
    """Score of each whole text by its letters alone, 0 to 1; null counts as empty. ``scored`` reads its words too."""
    plain = ToxicityModel(model.ratio, model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(_bytes(texts)))

    return score.asNondeterministic()(text)  # so that it is computed once


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1, in place of the text; null counts as empty."""
    if model.words is None:
        return docs.withColumn(score_col, toxicity(F.col(text_col), model, docs)).drop(text_col)
    plain = ToxicityModel(model.ratio, model.weights)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    @arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array(list(shared.value.features(_bytes(texts))), pa.list_(pa.float64()))

    key, own, mean = (free_name(docs, name) for name in ("key", "features", "mean"))
    means = model.words.means(docs.select(F.col(text_col).alias("text"), word_pairs.text_key(F.col(text_col)).alias("key")))
    means = means.select(F.col("key").alias(key), F.col("mean").alias(mean))
    found = docs.withColumns({key: word_pairs.text_key(F.col(text_col)), own: features.asNondeterministic()(text_col)}).drop(text_col)
    found = found.hint("merge").join(means, key)
    *weights, bias = model.word_weights.tolist()
    line = F.lit(bias) + F.col(mean) * weights[-1]
    for k, weight in enumerate(weights[:-1]):
        line = line + F.col(own)[k] * weight
    return found.withColumn(score_col, 1 / (1 + F.exp(-line))).drop(key, own, mean)


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``limit``, unchanged, whatever columns they have."""
    texts = docs.select(word_pairs.text_key(F.col(text_col)).alias("rejected"), F.col(text_col).alias("text"))
    rejected = write_out(scored(texts, model).where(F.col("score") >= limit).select("rejected").distinct(), "rejected")
    # only texts that share a place with a rejected one move to the join
    near, hashed = free_name(docs, "near"), free_name(docs, "hashed")
    flagged = docs.withColumn(hashed, word_pairs.text_key(F.col(text_col)))
    flagged = flagged.withColumn(near, word_pairs.may_have(F.col(hashed), [word_pairs.bitmap(rejected.select(F.col("rejected").alias("hash")))], docs.sparkSession))
    met = flagged.where(F.col(near).isNotNull()).hint("merge")
    met = met.join(rejected, met[hashed] == rejected["rejected"], "left_anti")
    return flagged.where(F.col(near).isNull()).union(met).drop(near, hashed)
