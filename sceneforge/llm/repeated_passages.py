"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is WINDOW consecutive words of a document. Every window has an anchor:
its PHRASE-word phrase with the smallest hash, the first of them in a tie. Equal
windows have equal anchors at equal places, so only windows whose anchor phrase
occurs in several places can repeat.

1. Count the anchor phrases of all documents by hash and keep the recurring ones.
2. Deal the documents into shards of about SHARD by the hash of their id. Each
   shard compiles the recurring phrases that its documents have into an automaton
   and streams its documents through it, which finds every occurrence by its words.
   Windows around occurrences are settled within the shard; only the first of
   each kind goes on, so a window of the whole corpus is a row per shard at most.
3. All windows that go on are shuffled once, by hash, and numbered by place; all but
   the first of each hash repeat. A hash has a row per shard at most, which Spark
   spills; the rows of one phrase never meet.
4. Each shard marks the words of its repeated windows and joins the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sceneforge.llm import words
from sceneforge.session import write_out

WINDOW, PHRASE = 20, 8
SHARD = 512
"""Documents a shard has on average."""
_PLACES = WINDOW - PHRASE + 1
_NO_ID = -(1 << 63)


def _anchors(block: words.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes by first word (0 where none fits), first words of all windows, their anchors, their hashes."""
    phrases = np.zeros(len(block.hashes), dtype=np.uint64)
    hashes, index = block.runs(PHRASE)
    phrases[index] = hashes
    windows, first = block.runs(WINDOW)
    best, place = phrases[first], np.zeros(len(first), dtype=np.int64)
    for k in range(1, _PLACES):
        other = phrases[first + k]
        less = other < best
        best = np.where(less, other, best)
        place[less] = k
    return phrases, first, first + place, windows


def _shard(doc_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def _recurring(docs: DataFrame) -> DataFrame:
    """(shard, phrase): hashes of anchor phrases that occur more than once, in each shard that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            for block in words.blocks(batch.column("text")):
                phrases, _, anchors, _ = _anchors(block)
                anchors = np.unique(anchors)
                of = shard[block.first + block.text_of_word()[anchors]]
                found = phrases[anchors]
                order = np.lexsort((of, found))
                found, of = found[order], of[order]
                fresh = np.ones(len(found), dtype=bool)
                fresh[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
                begins = np.flatnonzero(fresh)
                times = np.diff(np.append(begins, len(found)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[begins]), pa.array(words.signed(found[begins])), pa.array(times.astype(np.int32))],
                    ["shard", "phrase", "times"],
                )

    counts = docs.select("shard", "text").mapInArrow(run, "shard int, phrase long, times int")
    total = F.sum("times").over(Window.partitionBy("phrase"))
    return counts.withColumn("total", total).where("total > 1").select("shard", "phrase")


def _sorted_shard(docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The documents by id and text, their ids, and a number for documents with equal ids."""
    docs = docs.set_column(docs.schema.get_field_index("doc_id"), "doc_id", pc.fill_null(docs["doc_id"], _NO_ID))
    docs = docs.take(pc.sort_indices(docs, [("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
    ids = docs["doc_id"].to_numpy()
    begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    copy = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
    return docs, ids, copy


def _text_column(docs: pa.Table) -> pa.Array:
    column = docs["text"]
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _occurrences(block: words.Block, phrases: np.ndarray, anchors: np.ndarray, recurring: np.ndarray) -> np.ndarray:
    """Which words begin a recurring phrase, found by an automaton of the phrases of this block."""
    found = np.zeros(len(block.hashes), dtype=bool)
    places = np.unique(anchors)
    places = places[np.isin(phrases[places], recurring)]
    places = places[np.unique(phrases[places], return_index=True)[1]]
    if not len(places):
        return found
    raw = block.data.tobytes()
    span = lambda a, b: " ".join(x.decode("utf-8", "replace") for x in raw[block.starts[a]:block.ends[b - 1]].split())
    automaton = ahocorasick.Automaton()
    for place in places.tolist():
        automaton.add_word(f" {span(place, place + PHRASE)} ", 0)
    automaton.make_automaton()
    for text in range(block.texts()):
        begin, end = int(block.bounds[text]), int(block.bounds[text + 1])
        if end - begin < WINDOW:
            continue
        stream = f" {span(begin, end)} "
        ends = [at for at, _ in automaton.iter(stream)]
        if ends:
            gaps = np.flatnonzero(np.frombuffer(stream.encode("utf-32-le"), np.uint32) == 32)
            found[begin + np.searchsorted(gaps, np.array(ends)) - PHRASE] = True
    return found


_SETTLED = "shard int, doc_id long, copy int, start int, repeats int, hashes array<long>"


def _settle(docs: pa.Table, recurring: pa.Table) -> pa.Table:
    """Windows of one shard: ``repeats`` has a bit for each window of an anchor that came earlier in the shard;
    an anchor with a window that did not carries the hashes of its windows."""
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("copy", pa.int32()), ("start", pa.int32()), ("repeats", pa.int32()),
                        ("hashes", pa.list_(pa.int64()))])
    if not docs.num_rows or not recurring.num_rows:
        return schema.empty_table()
    shard = docs["shard"][0].as_py()
    docs, ids, copy = _sorted_shard(docs)
    wanted = recurring["phrase"].to_numpy().view(np.uint64)
    parts = []
    for block in words.blocks(_text_column(docs)):
        phrases, first, anchors, windows = _anchors(block)
        some = _occurrences(block, phrases, anchors, wanted)[anchors]
        first, anchors, windows = first[some], anchors[some], windows[some]
        text = block.text_of_word()[first]
        parts.append((windows, block.first + text, first - block.bounds[text], anchors - block.bounds[text]))
    if not parts:
        return schema.empty_table()
    windows, text, start, anchor = (np.concatenate(x) for x in zip(*parts))
    if not len(windows):
        return schema.empty_table()
    order = np.argsort(windows, kind="stable")  # rows are in the order of ids, copies and starts
    again = np.zeros(len(windows), dtype=bool)
    again[order[1:]] = windows[order[1:]] == windows[order[:-1]]
    begins = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(begins, len(windows)))
    bit = np.arange(len(windows)) - np.repeat(begins, sizes)
    repeats = np.add.reduceat(np.where(again, 1 << bit, 0), begins)
    goes_on = np.add.reduceat(~again, begins) > 0
    lengths = np.where(goes_on, sizes, 0)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Table.from_arrays([
        pa.array(np.full(len(begins), shard, np.int32)), pa.array(ids[text[begins]]), pa.array(copy[text[begins]].astype(np.int32)),
        pa.array(start[begins].astype(np.int32)), pa.array(repeats.astype(np.int32)),
        pa.ListArray.from_arrays(offsets, pa.array(words.signed(windows[np.repeat(goes_on, sizes)]))),
    ], schema=schema)


def _later(settled: DataFrame, shards: int) -> DataFrame:
    """Of windows that are the first of their kind in a shard, those that are not the earliest of all."""
    each = settled.select("doc_id", "copy", "start", "repeats", F.posexplode("hashes").alias("bit", "hash"))
    each = each.where("(shiftright(repeats, bit) & 1) = 0")
    place = F.shiftleft(F.col("copy").cast("long"), 32) + F.col("start") + F.col("bit")
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("doc_id", "place"))
    met = each.select("hash", "doc_id", place.alias("place")).withColumn("rank", rank).where("rank > 1")
    return met.select(
        _shard(F.col("doc_id"), shards).alias("shard"), "doc_id", F.shiftright("place", 32).cast("int").alias("copy"),
        F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("start"), F.lit(1).alias("repeats"),
    )


def _marks(docs_ids: np.ndarray, copies: np.ndarray, repeats: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows and first words of the repeated windows of one shard."""
    rows = {(d, c): i for i, (d, c) in enumerate(zip(docs_ids.tolist(), copies.tolist()))}
    row = np.fromiter((rows[d, c] for d, c in zip(repeats["doc_id"].to_pylist(), repeats["copy"].to_pylist())), np.int64, repeats.num_rows)
    mask, start = repeats["repeats"].to_numpy(), repeats["start"].to_numpy()
    bits = np.arange(_PLACES)
    which, bit = np.nonzero((mask[:, None] >> bits) & 1)
    return row[which], start[which] + bit


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", verbatim: bool = False) -> DataFrame:
    """Documents without the words of passages that occur earlier: doc_id, n_words, n_removed, kept, others.

    A word goes when a window of 20 words that covers it starts earlier too: in a
    document with a smaller id, or before in the same document. Windows are judged
    on the input. ``kept`` joins the other words by one space; with ``verbatim`` a
    text that loses nothing stays as it is. Null texts have no words (``kept`` is
    empty, or null if ``verbatim``). Of rows with one id the smaller text counts as
    earlier, and equal rows follow each other; a null id comes before all others.
    ``others`` is a struct of all further columns, whatever their names.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    carried = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(None).cast("int").alias("none"))
    shards = max(1, -(-docs.count() // SHARD))
    key = F.col(id_col).cast("long")
    docs = docs.select(_shard(F.coalesce(key, F.lit(_NO_ID)), shards).alias("shard"), key.alias("doc_id"), F.col(text_col).alias("text"), carried.alias("others"))
    recurring = write_out(_recurring(docs), "phrases")
    texts = docs.select("shard", "doc_id", "text")
    settled = write_out(texts.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(_settle, _SETTLED), "windows")
    repeats = settled.where("repeats <> 0").select("shard", "doc_id", "copy", "start", "repeats").union(_later(settled, shards))

    def finish(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        docs, ids, copies = _sorted_shard(docs)
        rows, starts = _marks(ids, copies, repeats)
        order = np.argsort(rows, kind="stable")
        rows, starts = rows[order], starts[order]
        bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(docs["text"]):
            raw = text.as_py()
            found = (raw or "").encode().split()
            change = np.zeros(len(found) + 1, dtype=np.int64)
            own = starts[bounds[i]:bounds[i + 1]]
            np.add.at(change, own, 1)
            np.add.at(change, own + WINDOW, -1)
            stay = np.cumsum(change[:-1]) == 0
            n_words.append(len(found))
            n_removed.append(int(len(found) - stay.sum()))
            if verbatim and not n_removed[-1]:
                kept.append(raw)
            else:
                kept.append(b" ".join(found if not len(own) else [found[k] for k in np.flatnonzero(stay)]).decode())
        out_ids = pc.if_else(pc.equal(docs["doc_id"], _NO_ID), None, docs["doc_id"]).combine_chunks()
        return pa.table({
            "doc_id": out_ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.string()), "others": docs["others"],
        })

    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()), docs.schema["others"],
    ])
    return docs.groupBy("shard").cogroup(repeats.groupBy("shard")).applyInArrow(finish, schema)
