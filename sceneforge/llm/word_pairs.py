"""Kneser-Ney models of words after words for two classes, as Spark tables.

A word is a run of ASCII letters (of any case), digits and characters beyond ASCII;
each text begins and ends with a mark. Bigrams count as often as they occur in a
class, single words in as many contexts as they have there; below both are the
contexts of both classes together, for words that neither knows.

The difference of the two log-probabilities is a sum over the words and bigrams of a
text: each has a value in a table that is as long as the corpus needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from sceneforge.llm import words
from sceneforge.session import write_out

START, END = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344))
FILTER_BITS = 26
"""2 to this many bits tell which n-grams the table may have; the join decides."""
SPAN_BYTES, SPAN_TEXTS = 8 << 20, 1 << 14
"""Texts whose n-grams are looked up together, each once."""
ROWS = 1 << 16
"""Most rows of a batch that goes back to Spark."""
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [c if chr(c).isalnum() else 32 for c in range(128)]


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _pairs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bigrams of some texts, their first and second words, and the texts they are in."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_PLAIN[data]))
    for block in words.blocks(texts, fold=True):
        count = block.texts()
        marked = np.empty(len(block.hashes) + 2 * count, dtype=np.uint64)
        marked[np.arange(len(block.hashes)) + 2 * block.text_of_word() + 1] = block.hashes
        ends = block.bounds[1:] + 2 * np.arange(count) + 1
        marked[block.bounds[:-1] + 2 * np.arange(count)], marked[ends] = START, END
        first = np.ones(len(marked), dtype=bool)
        first[ends] = False
        first = np.flatnonzero(first)
        context, low = marked[first], marked[first + 1]
        yield words.mix(words.mix(context) + low), context, low, block.first + np.searchsorted(ends, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label").to_numpy()
        for gram, context, low, text in _pairs(batch.column("text")):
            _, place, which = np.unique(gram, return_index=True, return_inverse=True)
            toxic = np.bincount(which, label[text], len(place)).astype(np.int64)
            both = np.bincount(which, minlength=len(place))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(words.signed(x[place])) for x in (gram, context, low)), pa.array(both - toxic), pa.array(toxic)],
                ["gram", "context", "low", "c0", "c1"],
            )


def _spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about SPAN_BYTES of text; a longer text is alone."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64))
    first = 0
    while first < len(sizes):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, min(int(np.searchsorted(sizes, before + SPAN_BYTES, side="right")), first + SPAN_TEXTS))
        yield batch.slice(first, last - first)
        first = last


def _postings(texts: pa.RecordBatch, span: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each n-gram of some texts (key, text) that the table may have, once, with the places of the texts that have it.

    A place comes as often as the n-gram does. The mark of the start has a row for
    each text, which tells the text's key and its number of words.
    """
    grams, places, words_of = [], [], np.zeros(texts.num_rows, np.int64)
    for gram, context, low, text in _pairs(texts.column("text")):
        last = low == END  # each word is a context once; the end never is
        every = np.concatenate((gram, context[context != START], low[last]))
        owner = np.concatenate((text, text[context != START], text[last]))
        place = words.signed(every) & ((1 << FILTER_BITS) - 1)
        some = np.flatnonzero((bitmap[place >> 6] >> (place & 63)) & 1)
        grams.append(every[some])
        places.append(owner[some].astype(np.int16))
        words_of += np.bincount(text, minlength=len(words_of))
    if not grams:
        return
    gram, place = np.concatenate(grams), np.concatenate(places)
    order = np.argsort(gram)
    gram, place = words.signed(gram[order]), place[order]
    begins = np.flatnonzero(np.diff(gram, prepend=~gram[:1]))
    bounds, names = np.append(begins, len(gram)), ["gram", "span", "places", "key", "words"]
    for k in range(0, len(begins), ROWS):
        own = bounds[k:k + ROWS + 1]
        count = len(own) - 1
        yield pa.RecordBatch.from_arrays([
            pa.array(gram[own[:-1]]), pa.array(np.full(count, span)), pa.ListArray.from_arrays((own - own[0]).astype(np.int32), pa.array(place[own[0]:own[-1]])),
            pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64()),
        ], names)
    count = texts.num_rows
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(count, words.signed(np.array([START]))[0])), pa.array(np.full(count, span)),
        pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32), pa.array(np.arange(count, dtype=np.int16))),
        texts.column("key"), pa.array(words_of),
    ], names)


def _discount(ones: int | None, twos: int | None) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def _ones_twos(*counts: str) -> list[Column]:
    return [F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in counts for k in (1, 2)]


@dataclass
class Table:
    """``values`` (gram, value), a filter of its n-grams, and the difference of a word that no text has."""

    values: DataFrame
    bitmap: np.ndarray
    unknown: float

    def means(self, texts: DataFrame) -> DataFrame:
        """(key, mean): difference of the log-probabilities a word, for each distinct text of ``texts`` (key, text)."""
        shared = texts.sparkSession.sparkContext.broadcast(self.bitmap)
        schema = "gram long, span long, places array<smallint>, key long, words long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, count = TaskContext.get().partitionId(), 0
            for batch in batches:
                batch = batch.take(pa.array(np.sort(np.unique(batch.column("key").to_numpy(), return_index=True)[1])))
                for some in _spans(batch):
                    yield from _postings(some, task << 32 | count, shared.value)
                    count += 1

        found = texts.select("key", "text").mapInArrow(run, schema)
        # both sides grow with the input: neither is ever broadcast
        met = found.hint("merge").join(self.values.hint("merge"), "gram")
        sums = met.select("span", F.explode("places").alias("place"), "value", "key", "words").groupBy("span", "place")
        sums = sums.agg(F.sum("value").alias("value"), F.max("key").alias("key"), F.sum("words").alias("words"))
        sums = sums.groupBy("key").agg(F.sum("value").alias("value"), F.sum("words").alias("words"))
        return sums.select("key", (F.col("value") / F.col("words") + self.unknown).alias("mean"))  # copies count alike above and below


def learn(marked: DataFrame) -> Table:
    """Table of all bigrams and words of labelled texts (text, label 0 or 1)."""
    pairs = marked.select("text", "label").mapInArrow(_count, "gram long, context long, low long, c0 long, c1 long")
    pairs = pairs.groupBy("gram").agg(F.first("context").alias("context"), F.first("low").alias("low"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    pairs = write_out(pairs, "word-pairs")
    lows = pairs.groupBy("low").agg(F.count_if(F.col("c0") > 0).alias("n0"), F.count_if(F.col("c1") > 0).alias("n1"), F.count("*").alias("n"))
    lows = write_out(lows, "word-lows")
    sums = lows.agg(
        *(F.sum(c).alias(c) for c in ("n0", "n1", "n")), *(F.count_if(F.col(c) > 0).alias("kinds_" + c) for c in ("n0", "n1", "n")), *_ones_twos("n0", "n1", "n"),
    ).first()
    d = {c: _discount(sums[f"{c}_1"], sums[f"{c}_2"]) for c in ("n0", "n1", "n")}
    spare = {c: d[c] * (sums[f"kinds_{c}"] or 0) / max(1, sums[c] or 0) for c in ("n0", "n1", "n")}
    part = lambda c: F.greatest(F.col(c) - d[c], F.lit(0.0)) / max(1, sums[c] or 0)
    pooled = part("n") + spare["n"] / ((sums["kinds_n"] or 0) + 1)
    lower = lambda c: part(c) + pooled * (spare[c] or 1.0)
    unknown = float(np.log(spare["n1"] or 1.0) - np.log(spare["n0"] or 1.0))
    lows = lows.select("low", lower("n0").alias("p0"), lower("n1").alias("p1"))

    twos = pairs.agg(*_ones_twos("c0", "c1")).first()
    discount = [_discount(twos[f"c{k}_1"], twos[f"c{k}_2"]) for k in (0, 1)]
    contexts = pairs.groupBy("context").agg(*(x for k in (0, 1) for x in (F.sum(f"c{k}").alias(f"t{k}"), F.count_if(F.col(f"c{k}") > 0).alias(f"kinds{k}"))))
    contexts = write_out(contexts.select("context", "t0", "t1", *(
        F.when(F.col(f"t{k}") > 0, F.col(f"kinds{k}") * discount[k] / F.col(f"t{k}")).otherwise(1.0).alias(f"spare{k}") for k in (0, 1)
    )), "word-contexts")

    own = [(F.greatest(F.col(f"c{k}") - discount[k], F.lit(0.0)) / F.greatest(f"t{k}", F.lit(1))).alias(f"own{k}") for k in (0, 1)]
    joined = pairs.hint("merge").join(contexts.hint("merge"), "context").select("gram", "low", *own, "spare0", "spare1").join(lows.hint("merge"), "low")
    full = [F.col(f"own{k}") + F.col(f"spare{k}") * F.col(f"p{k}") for k in (0, 1)]
    back = F.log("spare1") - F.log("spare0")
    single = F.log("p1") - F.log("p0")
    of_pairs = joined.select("gram", (F.log(full[1]) - F.log(full[0]) - back - single).alias("value"))
    # a word's own value and that of the backoff after it; the start is no word, the end no context
    of_words = contexts.hint("merge").join(lows.hint("merge"), contexts["context"] == lows["low"], "full").select(
        F.coalesce("context", "low").alias("gram"), (F.coalesce(single - unknown, F.lit(0.0)) + F.coalesce(back, F.lit(0.0))).alias("value"))
    values = write_out(of_pairs.union(of_words), "word-values")
    return Table(values, bitmap(values.select(F.col("gram").alias("hash"))), unknown)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for the last FILTER_BITS bits of each ``hash``; fixed size."""
    place = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = hashes.select(place.alias("place")).selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, CAST(place & 63 AS INT)) AS bit")
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    whole = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    whole[found["word"].to_numpy()] = found["bits"].to_numpy()
    return whole


def may_have(hashes: Column, bitmaps: list[np.ndarray], spark: SparkSession) -> Column:
    """The number of the first bitmap that has a hash; null if none does or the hash is null."""
    shared = spark.sparkContext.broadcast(bitmaps)

    @arrow_udf("int")
    def which(hashes: pa.Array) -> pa.Array:
        place = hashes.fill_null(0).to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)
        found = np.full(len(place), -1, np.int32)
        for k in range(len(shared.value) - 1, -1, -1):
            found[((shared.value[k][place >> 6] >> (place & 63)) & 1) > 0] = k
        return pa.array(found, mask=(found < 0) | hashes.is_null().to_numpy(zero_copy_only=False))

    return which.asNondeterministic()(hashes)  # so that it is computed once
