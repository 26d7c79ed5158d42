"""Which sources of a language use its words differently, in exact whole numbers.

Terms are lower-cased (A-Z only) runs of letters and of all beyond ASCII. A
language keeps the terms in at least ``min_docs`` of its documents. A group
(language, source), and each language as a whole, gives a kept term with ``count``
occurrences there the weight p = 1 + floor(SCALE * (count + 1) / (N + V)), N being
the group's occurrences of kept terms and V the number of those. Two weights p
and q are priced floor((p - q)^2 / q).

The price of a group against another is a sum over all kept terms, but terms with
the same two counts cost the same. So each group has an indicator column per
count level that its terms take (counts of a group share a level when they have
the same weight), and the matrix of these columns, multiplied by its transpose,
holds every joint table: how many terms have one level here and another there.
The product is made in blocks of about ``TERMS`` terms by two blocks of about
``SOURCES`` sources, in whole numbers; blocks add up. Terms that a group lacks
have level zero and no entry; their cells follow from the totals of the levels.

Sums stay within 64 bits while a language keeps under 5 * 10^8 terms. Null texts, languages and
sources count as empty text; each row of the table counts as a document, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneforge.llm.common import group_starts, whole_groups
from sceneforge.session import write_out

SCALE = 1_000_000_000
TERMS = 1024
SOURCES = 64
BLOCK_BYTES = 16 << 20
_TILE_CELLS = 16 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_LETTER = np.arange(256) >= 128
_LETTER[ord("a"):ord("z") + 1] = True


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column in a row, and where each begins."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buffer = column.buffers()[2]
    return np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8), offsets


def _block_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Terms of some texts and the text each is in."""
    data = _FOLD[data]
    inside = _LETTER[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | cut[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | cut[1:])) + 1
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
    return terms.dictionary_encode(), np.searchsorted(offsets, starts, side="right") - 1


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, the sum of their values and how often each occurs."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[begins], np.add.reduceat(values[order], begins), np.diff(np.append(begins, len(keys)))


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms by group, added up over blocks of texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        data, offsets = _texts(batch.column(2))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            terms, text = _block_terms(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            size = len(terms.dictionary)
            if size:
                per_text, n = np.unique(text * size + terms.indices.to_numpy(), return_counts=True)
                keys, total, docs = _sums(group[first + per_text // size] * size + per_text % size, n)
                of = keys // size
                yield pa.RecordBatch.from_arrays([
                    langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))),
                    terms.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(total), pa.array(docs.astype(np.int64)),
                ], ["lang", "source", "term", "n", "docs"])
            first = last


def term_counts(docs: DataFrame) -> DataFrame:
    """How often each group (lang, source) of ``docs`` has each term: n occurrences in docs documents."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = named.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _weight(count: Column, n: Column, v: Column) -> Column:
    top = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(n + v > 0, F.call_function("div", top, (n + v).cast("decimal(20,0)")) + 1).otherwise(1).cast("long")


def _price(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Cells of joint tables that are not zero, block by block, for two levels above zero.

    Yields the language, the names, weights and zero weights of the columns on both sides, and index
    on the left, index on the right and number of terms of each cell.
    """
    for table in whole_groups(batches, ["lang", "block", "low", "high"]):
        keys = ["lang", "block", "low", "high"]
        for block in _split(table, keys):
            low, high = block["low"][0].as_py(), block["high"][0].as_py()
            side = block["part"].to_numpy()
            term = block["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            left, right = (_columns(block, np.flatnonzero(side == s), term) for s in (low, high))
            if not (len(left[0]) and len(right[0])):
                continue
            rows = np.zeros((int(term.max()) + 1, len(right[0])), dtype=np.int32)
            rows[right[3], right[4]] = 1  # the indicator columns of one side, a row per term
            entries, begins = left[3], np.searchsorted(left[4], np.arange(len(left[0])))
            step = max(1, _TILE_CELLS // len(right[0]))
            at = 0
            while at < len(left[0]):
                # as many columns of the other side as have about ``step`` entries
                end = max(at + 1, int(np.searchsorted(begins, begins[at] + step, side="right")) - 1)
                end = len(left[0]) if begins[-1] <= begins[at] + step else end
                stop = begins[end] if end < len(begins) else len(entries)
                product = np.add.reduceat(rows[entries[begins[at]:stop]], begins[at:end] - begins[at], axis=0)
                a, b = np.nonzero(product)
                yield block["lang"][0].as_py(), left[:3], right[:3], a + at, b, product[a, b].astype(np.int64), low == high
                at = end


def _split(table: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    begins = group_starts(table, keys)
    for begin, end in zip(begins, [*begins[1:], table.num_rows]):
        yield table.slice(begin, end - begin)


def _columns(block: pa.Table, index: np.ndarray, term: np.ndarray) -> tuple:
    """Indicator columns of some rows: source, weight and zero weight of each; term and column of each entry, by column."""
    names = block["source"].combine_chunks().dictionary_encode()
    source, p, p0 = names.indices.to_numpy()[index], block["p"].to_numpy()[index], block["p0"].to_numpy()[index]
    order = np.lexsort((p, source))
    source, p, p0 = source[order], p[order], p0[order]
    fresh = np.concatenate(([True], (source[1:] != source[:-1]) | (p[1:] != p[:-1])))[:len(order)]
    column = np.cumsum(fresh) - 1
    return np.array(names.dictionary.to_pylist(), dtype=object)[source[fresh]], p[fresh], p0[fresh], term[index][order], column


def _table_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, (s, p, _), (t, q, _), a, b, n, same in _cells(batches):
        keep = s[a] != t[b] if same else np.ones(len(a), bool)
        a, b, n = a[keep], b[keep], n[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(a), pa.string()), pa.array(s[a], pa.string()), pa.array(p[a]), pa.array(t[b], pa.string()), pa.array(q[b]), pa.array(n)],
            ["lang", "source", "p", "other", "q", "n"])


def _priced_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What cells of two levels above zero add to the price of a group against another, beyond the two levels' own parts."""
    price = lambda p, q: (p - q) ** 2 // q
    for lang, (s, p, p0), (t, q, q0), a, b, n, same in _cells(batches):
        for (x, px, x0, i), (y, py, y0, j) in (((s, p, p0, a), (t, q, q0, b)), ((t, q, q0, b), (s, p, p0, a)))[:1 if same else 2]:
            xs, xi = np.unique(x.astype(str), return_inverse=True)
            ys, yi = np.unique(y.astype(str), return_inverse=True)
            value = n * (price(px[i], py[j]) - price(px[i], y0[j]) - price(x0[i], py[j]) + price(x0[i], y0[j]))
            pairs, total, _ = _sums(xi[i] * len(ys) + yi[j], value)
            keep = xs[pairs // len(ys)] != ys[pairs % len(ys)]
            pairs, total = pairs[keep], total[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(pairs), pa.string()), pa.array(xs[pairs // len(ys)], pa.string()), pa.array(ys[pairs % len(ys)], pa.string()), pa.array(total)],
                ["lang", "source", "item", "value"])


class Audit:
    """Counts and weights of a table, from which joint tables and prices are made."""

    def __init__(self, docs: DataFrame, min_docs: int = 3):
        counts = write_out(term_counts(docs), "term-counts")
        terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
        self.terms = write_out(terms, "kept-terms")
        kept = write_out(counts.join(self.terms, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-counts")
        found = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        sizes = self.terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
        own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_own"))
        shares = found.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
        groups = found.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").join(shares, "lang").na.fill(0, ["n_own", "v", "n_lang"])
        zero = _weight(F.lit(0), F.col("n_own"), F.col("v"))
        parts = F.ceil(F.col("n_sources") / SOURCES).cast("int")
        self.groups = write_out(groups.withColumns({"p0": zero, "parts": parts, "part": F.pmod(F.xxhash64("source"), parts).cast("int")}), "groups")
        entries = kept.join(self.groups, ["lang", "source"])
        block = F.pmod(F.xxhash64("term"), F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS))).cast("int")
        entries = entries.select(
            "lang", "source", "term", _weight(F.col("n"), F.col("n_own"), F.col("v")).alias("p"), _weight(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"),
            "p0", block.alias("block"), "part", "parts")
        self.entries = write_out(entries, "entries")

    def _blocks(self) -> DataFrame:
        """Entries at every pair of source blocks that theirs belongs to."""
        partner = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = self.entries.select("lang", "block", "part", "source", "term", "p", "p0", partner.alias("other"))
        dealt = dealt.select("lang", "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "source", "term", "p", "p0")
        keys = ["lang", "block", "low", "high"]
        return dealt.repartition(*keys).sortWithinPartitions(*keys)

    def joint_tables(self) -> DataFrame:
        """How many kept terms have weight p in one source and q in another of a language, both occurring there."""
        parts = self._blocks().mapInArrow(_table_rows, "lang string, source string, p long, other string, q long, n long")
        return parts.groupBy("lang", "source", "p", "other", "q").agg(F.sum("n").alias("n"))

    def pairs(self) -> DataFrame:
        """The price of each group against each other source of its language, summed over all kept terms."""
        wide = lambda c: c.cast("decimal(38,0)")
        group = self.groups.select("lang", "source", "p0", "v")
        other = group.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
        both = group.join(other, "lang").where("source <> item")
        none = both.select("lang", "source", "item", wide(F.col("v").cast("decimal(19,0)") * _price("p0", "q0").cast("decimal(19,0)")).alias("value"))
        levels = self.entries.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
        mine = levels.join(other, "lang").where("source <> item").select(
            "lang", "source", "item", wide(F.col("terms") * (_price("p", "q0") - _price("p0", "q0"))).alias("value"))
        theirs = levels.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), "terms").join(group, "lang").where("source <> item").select(
            "lang", "source", "item", wide(F.col("terms") * (_price("p0", "q") - _price("p0", "q0"))).alias("value"))
        joint = self._blocks().mapInArrow(_priced_rows, "lang string, source string, item string, value long").withColumn("value", wide(F.col("value")))
        parts = none.unionByName(mine).unionByName(theirs).unionByName(joint)
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    def over_used(self) -> DataFrame:
        """Terms that weigh more in a group than in its language, with their price."""
        return self.entries.where("p > q").select("lang", "source", F.col("term").alias("item"), _price("p", "q").alias("value"))

    def report(self, top: int = 200) -> DataFrame:
        """Other sources of each group by price, and its ``top`` terms."""
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = lambda df, part: df.withColumns({"part": F.lit(part), "rank": F.row_number().over(order)})
        rows = ranked(self.pairs(), "pair").unionByName(ranked(self.over_used(), "term").where(F.col("rank") <= top))
        return rows.select("lang", "source", "part", "item", "value", "rank")
