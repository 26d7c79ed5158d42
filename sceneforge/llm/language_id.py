"""Language identification by compression with a zstandard dictionary per language.

Text that is like a language's sample shrinks most with that sample as raw-content
dictionary. A text is compressed once per language, stretch by stretch, so that a
long text does not become its own dictionary; the smallest sum wins. A text whose
best two sums lie close together is rejected.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from sceneforge.llm.common import fold, free_name
from sceneforge.session import write_out

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCUMENTS = 1_000
"""Documents a language's sample is drawn from, about."""
SAMPLE_LINES, LINE_CHARACTERS = 2_000, 400
"""Lines of a sample, and what is taken of each."""
DICTIONARY_BYTES = 112 << 10
STRETCH_BYTES = 1 << 10
LEVEL = 6
MIN_MARGIN = 0.002
"""Least lead of the smallest size over the next, as a share of it."""
UNDETERMINED = "und"
_IGNORED = (string.digits + string.punctuation).encode()


def normal(text: str) -> bytes:
    """Lower-cased text without ASCII digits and punctuation."""
    return text.lower().encode().translate(None, _IGNORED)


@dataclass
class LanguageModel:
    """Languages and the samples they are told by."""

    languages: list[str]
    samples: list[bytes]

    def __post_init__(self) -> None:
        self._packers = None

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "samples": self.samples}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _sizes(self, data: bytes) -> list[int]:
        if self._packers is None:
            self._packers = []
            for sample in self.samples:
                own = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=LEVEL)
                self._packers.append(zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        parts = [data[i:i + STRETCH_BYTES] for i in range(0, len(data), STRETCH_BYTES)]
        return [sum(len(p.compress(part)) for part in parts) for p in self._packers]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and the lead of its size over the next as a share of that, 0 to 1; no letter: und and 0."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        sizes = self._sizes(normal(text))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(order) == 1:
            return self.languages[0], 1.0
        best, other = sizes[order[0]], sizes[order[1]]
        return self.languages[order[0]], (other - best) / max(1, other)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Samples from texts with a language outside the held-out fold.

    A sample is bounded: distinct lines in a hashed order, of documents drawn by a
    hash of their id at a rate set by the count of the language's documents. Ties in
    hash go by text. Without any language the model predicts und.
    """
    ids = F.col(id_col)
    rows = docs.where(ids.isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(ids, FOLDS) != HELD_OUT))
    rows = rows.select(ids.alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = write_out(rows.groupBy("lang").agg(F.count("*").alias("count")), "languages")
    place = (F.xxhash64(F.lit(11), "doc_id").cast("double") / 2.0**64 + 0.5)
    drawn = rows.join(F.broadcast(counts), "lang").where(place * F.col("count") < SAMPLE_DOCUMENTS)  # a row for each language
    lines = drawn.select("lang", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("lang", F.substring("line", 1, LINE_CHARACTERS).alias("line")).where("length(line) > 2").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(12), "line"), "line")
    found = lines.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_LINES).orderBy("lang", "rank").collect()
    languages = sorted({r.lang for r in found})
    samples = []
    for language in languages:
        sample = b"\n".join(normal(r.line) for r in found if r.lang == language)
        samples.append(sample[:DICTIONARY_BYTES])
    usable = [k for k, s in enumerate(samples) if len(s) >= 8]  # zstandard takes no shorter dictionary
    return LanguageModel([languages[k] for k in usable], [samples[k] for k in usable])


def language(text: Column, model: LanguageModel, docs: DataFrame) -> Column:
    """Predicted language of each whole text and how clear it is: struct of lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()(text)  # so that it is computed once


def accepted(prediction: Column) -> Column:
    return (prediction["lang_pred"] != UNDETERMINED) & (prediction["score"] >= MIN_MARGIN)


def reject_unclear(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language is clear, unchanged, whatever columns they have."""
    name = free_name(docs, "language")
    return docs.withColumn(name, language(F.col(text_col), model, docs)).where(accepted(F.col(name))).drop(name)
