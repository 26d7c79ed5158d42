"""Benchmark passages in documents, found by winnowing with column functions alone.

Words are lower-cased (A-Z only) runs of digits, letters and all beyond ASCII.
A window is ``window`` consecutive words of one item; an item with fewer words,
but at least one, is one window as a whole. A window of m words has w = m - k + 1
k-grams, k being half of m rounded up, and its fingerprint is the least hash of
them: both sides keep only that, so that every shared span of m words shares a
fingerprint. In a document, neighbouring windows mostly have the same least hash
and are kept as one run (hash, first window, last window), about two rows for
every seven words.

Runs whose hash is a fingerprint of an item are extended: the windows of a run
are spelled out from the document and joined with the items' windows by their
words, so no hash decides alone. A window that repeats within a document or is
shared by many items is found once per place and then looked up once per
document, so repeated words do not multiply.

Documents are told apart by id and text: rows that repeat both get the same
result, a null id is an id like others. Null and empty texts have no words and no
hits. Items without words have no windows; a null ``item_id`` counts as empty text, and
items that share an id count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sceneforge.llm.lexing import all_matches, ascii_lower, bind, places
from sceneforge.session import write_out

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return all_matches(ascii_lower(text), WORD)


def _minima(words: Column, m: int) -> Column:
    """For each window of ``m`` words, by its first word, the least hash of its k-grams."""
    k = (m + 1) // 2
    count = F.size(words) - m + 1
    grams = F.transform(
        places(F.when(count > 0, count + m - k).otherwise(0)), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    if m == k:
        return grams
    return bind(grams, lambda g: F.transform(places(count), lambda i: F.least(*(F.get(g, i + j) for j in range(m - k + 1)))))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """All different windows of ``items`` (item_id, text) with each item that has them: m, words as text, fingerprint, item."""
    read = write_out(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")), "item-words")
    length = F.least(F.size("words"), F.lit(window))
    parts = []
    for m in sorted(r.m for r in read.select(length.alias("m")).where("m > 0").distinct().collect()) or [window]:
        spelled = F.transform(_minima(F.col("words"), m), lambda least, i: F.struct(F.array_join(F.slice("words", i + 1, m), " ").alias("window"), least.alias("print")))
        found = read.where(length == m).select("item", F.lit(m).alias("m"), F.explode(spelled).alias("w"))
        parts.append(found.select("m", "w.window", "w.print", "item"))
    return _union(parts).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _runs(words: Column, lengths: list[int]) -> Column:
    """Stretches of neighbouring windows with one least hash, for windows of each length."""

    def of_length(m: int) -> Column:
        def stretches(minima: Column) -> Column:
            fresh = F.filter(places(F.size(minima)), lambda i: ~F.get(minima, i).eqNullSafe(F.get(minima, i - 1)))
            return bind(fresh, lambda starts: F.transform(starts, lambda i, at: F.struct(
                F.lit(m).alias("m"), F.get(minima, i).alias("print"), i.alias("first"), (F.coalesce(F.get(starts, at + 1), F.size(minima)) - 1).alias("last"))))

        return bind(_minima(words, m), stretches)

    return F.concat(*(of_length(m) for m in lengths))


def shared_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """What ``docs`` (doc_id, text) share with ``items`` (item_id, text): one row per document.

    ``n_words``; ``spans``, the stretches of words inside windows of items (first and last place,
    from 0); ``n_hit``, how many words those are; ``items``, ids as text in order.
    """
    pieces = write_out(item_windows(items, window), "windows")
    lengths = sorted(r.m for r in pieces.select("m").distinct().collect()) or [window]  # as many as ``window`` at most
    numbered = write_out(pieces.groupBy("m", "window").agg(F.min("print").alias("print")).withColumn("number", F.monotonically_increasing_id()), "numbered")
    holders = pieces.join(numbered, ["m", "window"]).select("number", "item").distinct()

    plain = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    cut = plain.select("doc_id", "key", bind(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _runs(w, lengths).alias("runs"))).alias("found"))
    # one more row keeps the document itself; its key spreads those rows over the tasks of a shuffled join
    itself = F.array(F.struct(F.lit(0).alias("m"), F.xxhash64("doc_id", "key").alias("print"), F.lit(-1).alias("first"), F.lit(-1).alias("last")))
    rows = cut.select("doc_id", "key", F.col("found.n").alias("n_words"), F.explode(F.concat(itself, "found.runs")).alias("run"))
    rows = rows.select("doc_id", "key", "n_words", "run.*")
    prints = numbered.select("m", "print").distinct().withColumn("known", F.lit(True))
    met = write_out(rows.join(prints, ["m", "print"], "left").where("known OR m = 0").drop("print", "known"), "runs-met")

    there = met.where("m > 0").groupBy("doc_id", "key").agg(F.collect_set(F.struct("m", "first", "last")).alias("runs"))
    known = plain.alias("d").join(there.alias("t"), F.expr("d.doc_id <=> t.doc_id AND d.key = t.key")).select("d.doc_id", "d.key", "t.runs", "d.text")
    spelled = bind(words(F.col("text")), lambda w: F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(
        r["m"].alias("m"), i.alias("first"), F.array_join(F.slice(w, i + 1, r["m"]), " ").alias("window"))))))
    windows = known.select("doc_id", "key", F.explode(spelled).alias("w")).select("doc_id", "key", "w.*")
    hits = write_out(windows.join(numbered.select("m", "window", "number"), ["m", "window"]).drop("window"), "hits")

    covered = F.flatten(F.collect_set(F.sequence(F.col("first"), F.col("first") + F.col("m") - 1)))
    spans = hits.groupBy("doc_id", "key").agg(F.sort_array(F.array_distinct(covered)).alias("places"))
    heads = F.filter("places", lambda p, i: ~F.get("places", i - 1).eqNullSafe(p - 1))
    tails = F.filter("places", lambda p, i: ~F.get("places", i + 1).eqNullSafe(p + 1))
    spans = spans.select("doc_id", "key", F.size("places").cast("long").alias("n_hit"), F.arrays_zip(heads.alias("first"), tails.alias("last")).alias("spans"))
    named = hits.select("doc_id", "key", "number").distinct().join(holders, "number").groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = spans.alias("s").join(named.alias("n"), F.expr("s.doc_id <=> n.doc_id AND s.key = n.key")).select("s.*", "n.items")

    whole = met.where("m = 0").alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.key = f.key"), "left")
    return whole.select(
        "d.doc_id", "d.n_words", F.coalesce("f.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("f.spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"), F.coalesce("f.items", F.array().cast("array<string>")).alias("items"))
