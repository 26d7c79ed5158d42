"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the K smallest distinct shingle hashes. Sketches of
parts merge to the sketch of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 128
WIDTH = 5
"""Words a shingle has."""
BUCKET_ROWS = 256
"""Documents that a run of neighbours has on average, as long as MAX_BUCKETS allows it."""
MAX_BUCKETS = 4096
_SPACE = "[\\x20\\x09-\\x0D]+"


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct hashes of the runs of ``width`` words of a lower-cased text.

    Fewer words are one run; a null text or one without words has none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")

    def runs(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
        few = F.array(F.xxhash64(w))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.get(F.transform(F.array(words), runs), F.lit(0)))


def sketch(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest of an array of distinct hashes."""
    return F.slice(F.sort_array(hashes), 1, k)


def merge(first: Column, second: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return sketch(F.array_union(first, second), k)


def distinct_shingles(own: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``."""
    share = (F.element_at(own, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(own) < k, F.size(own).cast("double")).otherwise(F.lit(k - 1.0) / share)


def resemblance(first: Column, second: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; of two empty sets 1, of an empty one and another 0."""
    union = merge(first, second, k)
    common = F.size(F.array_intersect(F.array_intersect(union, first), second))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common.cast("double") / F.size(union))


def containment(first: Column, second: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second has too; 1 for an empty first set."""
    both = resemblance(first, second, k) * distinct_shingles(merge(first, second, k), k)
    return F.when(F.size(first) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(first, k)))


def as_text(own: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal."""
    return F.array_join(F.transform(own, lambda h: F.lower(F.hex(h))), ".")


def with_next(rows: DataFrame, ids: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Each row with ``fields`` of the row after it in descending order of id, as struct ``next``; after the last comes the first.

    Equal ids are ordered by the fields, null ids come last. Rows are cut into ranges
    of ids, at most MAX_BUCKETS; the first row of a range is also sent to the range
    before it, so that one shuffle does. ``ids`` has the same ids, without costly columns.
    """
    count = ids.count()
    cuts = max(1, min(MAX_BUCKETS, count // BUCKET_ROWS))
    shares = [i / cuts for i in range(1, cuts)]
    bounds = ids.select(F.percentile_approx(id_col, shares, 100_000)).first()[0] if shares else []
    bounds = sorted(set(bounds or []))
    cut = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    range_of = F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.size(F.filter(cut, lambda b: b <= F.col(id_col))))
    tops = ids.groupBy(range_of.alias("range")).agg(F.max(id_col).alias("top")).orderBy(F.desc("range")).collect()
    ahead = [(tops[k - 1].range, tops[k].top) for k in range(len(tops))]  # the range before, and what it needs; the last before the first
    tops_at = F.array(*(F.lit(top) for _, top in ahead)).cast("array<bigint>")
    sent_to = F.array(*(F.lit(where) for where, _ in ahead)).cast("array<int>")
    found = F.when(F.col(id_col).isNull(), F.array_size(tops_at)).otherwise(F.array_position(tops_at, F.col(id_col))).cast("int")
    places = F.array(F.struct(range_of.alias("range"), F.lit(False).alias("sent")))
    also = F.array(F.struct(F.get(sent_to, found - 1).alias("range"), F.lit(True).alias("sent")))
    rows = rows.withColumn("at", F.explode(F.when(found > 0, F.concat(places, also)).otherwise(places)))
    rows = rows.select("*", "at.range", "at.sent").drop("at")
    order = [F.col("sent"), F.desc_nulls_last(id_col), *(F.desc_nulls_last(c) for c in fields)]
    return rows.withColumn("next", F.lead(F.struct(*fields)).over(Window.partitionBy("range").orderBy(*order))).where("NOT sent").drop("range", "sent")


def edited(text: Column, following: Column) -> Column:
    """A text whose last half is replaced by as many first characters of the one that follows, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts, of their edited texts, and how alike these are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_shingles (estimated). Null texts count as empty; two
    texts without words are alike (1). One row per input row. Further columns are
    not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", sketch(shingle_hashes(F.col("text"))))
    rows = with_next(rows, docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", ["text", "sketch"])
    rows = rows.select("doc_id", "text", "sketch", "next", edited(F.col("text"), F.col("next.text")).alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(shingle_hashes(F.col("edited"))))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )
