"""Source audit, decontamination and spelling variants against plain versions, and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from compare import differences, duck
from sceneforge.llm import common, decontamination, divergence, queries, spelling

NEW = ["op11_source_divergence", "op12_decontamination", "op13_spelling_variants"]
REPEATED = " ".join(["again"] * 400)
LONG = " ".join(f"Word{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}x" for i in range(1_500))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", "a"), (4, "one", "en", "a"), (5, "Two words", "en", None),
    (6, LONG, "en", "b"), (7, LONG, "en", "b"), (None, f"no id {PASSAGE} here", "en", "a"), (None, f"no id {PASSAGE} here", "en", "c"),
    (8, "é漢字🙂 Größe größe GRÖSSE 12a", "de", "c"), (9, REPEATED, "en", "c"), (10, f"{PASSAGE} {PASSAGE.upper()}", "fr", "b"),
    (11, "ein wort Two, WORDS! ein", "fr", "c"), (12, "x" * 400, "fr", "c"), (13, "mother mothers mother brother mothr mothar", "fr", "b"),
]
ITEMS = [
    (1, PASSAGE), (1, "two three"), (2, "AGAIN " * 30), (3, ""), (4, None), (None, "two words"), (5, "größe"), (6, "nowhere to be found"), (7, "four five six seven eight nine ten eleven twelve ONE two"),
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = spark.createDataFrame(ODD * 5, "doc_id long, text string, lang string, source string")
    rows.withColumns({c: F.lit(c) for c in ("term", "n", "p", "key", "words", "runs", "word", "run", "h", "lang_", "item", "m")}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1)).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory, odd_dir):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    return folder


def glob_duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", NEW)
def test_odd_rows_equal_sql(name, spark, odd_dir):
    assert differences(queries.QUERIES[name](spark, odd_dir), glob_duck(odd_dir), queries.SQL[name]) == []


@pytest.mark.parametrize("name", NEW)
def test_empty_tables(name, spark, empty_dir):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


def test_no_items_leaves_all_documents_clean(spark, odd_dir, empty_dir):
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for d, t in ((odd_dir, "documents"), (empty_dir, "benchmark")))
    rows = decontamination.shared_passages(docs, items).collect()
    assert len(rows) == 5 * len(ODD) and not any(r.n_hit or r.spans or r.items for r in rows)


def test_native_query_uses_no_python(spark, sf_dir):
    plan = contract.queries()["op12_decontamination"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 12: plain version

def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_spans(text, items, window=10):
    words, hit, names = plain_words(text), set(), set()
    for item, other in items:
        other = plain_words(other)
        m = min(len(other), window)
        wanted = {tuple(other[i:i + m]) for i in range(len(other) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i:i + m]) in wanted:
                hit.update(range(i, i + m))
                names.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(names)


def test_spans_equal_plain_version(spark):
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, draw(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 25])]
    items = [(k, t.replace("a", "x") if k < 5 else t) for k, t in items]
    docs = [(k, draw(rng.randrange(120)) + " " + rng.choice(items)[1] + " " + draw(3)) for k in range(60)]
    found = decontamination.shared_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r for r in found.collect()}
    for k, text in docs:
        n, hit, names = plain_spans(text, items)
        covered = [p for s in got[k].spans for p in range(s.first, s.last + 1)]
        assert (got[k].n_words, covered, got[k].n_hit, list(got[k].items)) == (n, hit, len(hit), names)
        assert all(a.last + 1 < b.first for a, b in zip(got[k].spans, got[k].spans[1:]))


def test_every_shared_span_has_a_common_fingerprint(spark):
    text = " ".join(f"t{i * i % 101}" for i in range(300))
    words = spark.createDataFrame([(text,)], "text string").select(decontamination.words(F.col("text")).alias("words"))
    run = words.select(F.explode(decontamination._runs(F.col("words"), [10])).alias("r")).select("r.*").collect()
    covered = sorted(i for r in run for i in range(r.first, r.last + 1))
    assert covered == list(range(291))  # each window is in one run
    assert len(run) < 0.45 * 291


# 11: plain version

def test_joint_tables_equal_plain_version(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 50)
    monkeypatch.setattr(divergence, "SOURCES", 3)
    docs = common.documents(spark, sf_dir)
    audit = divergence.Audit(docs)
    entries = defaultdict(dict)
    for r in audit.entries.collect():
        entries[r.lang, r.term][r.source] = r.p
    expected = Counter()
    for (lang, _), of in entries.items():
        expected.update((lang, s, p, t, q) for s, p in of.items() for t, q in of.items() if s != t)
    got = {}
    for r in audit.joint_tables().collect():
        for key in ((r.lang, r.source, r.p, r.other, r.q), (r.lang, r.other, r.q, r.source, r.p)):
            assert got.setdefault(key, r.n) == r.n
    assert got == expected
    assert differences(audit.report(), duck(sf_dir), queries.SQL["op11_source_divergence"]) == []


def test_products_in_narrow_tiles(monkeypatch):
    rng = np.random.default_rng(3)
    rows = sorted({(int(t), f"s{s}"): int(p) for t, s, p in rng.integers(0, [40, 6, 5], (150, 3))}.items())
    batch = pa.RecordBatch.from_pydict({
        "lang": ["x"] * len(rows), "block": pa.array([0] * len(rows), pa.int32()), "low": pa.array([0] * len(rows), pa.int32()), "high": pa.array([0] * len(rows), pa.int32()),
        "part": pa.array([0] * len(rows), pa.int32()), "source": [k[1] for k, _ in rows], "term": [str(k[0]) for k, _ in rows], "p": [p for _, p in rows], "p0": [1] * len(rows)})
    expected = Counter()
    for (t, s), p in rows:
        expected.update((s, p, u, q) for (v, u), q in rows if v == t)
    for cells in (1, 100, 1 << 20):
        monkeypatch.setattr(divergence, "_TILE_CELLS", cells)
        got = {}
        for _, (s, p, _), (u, q, _), a, b, n, _ in divergence._cells([batch]):
            got.update({(s[i], p[i], u[j], q[j]): k for i, j, k in zip(a, b, n)})
        assert got == expected


# 13: plain version

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("cell, sample", [(4096, 50_000), (8, 50_000), (8, 30)])
def test_near_words_equal_plain_version(spark, monkeypatch, cell, sample):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("aabcdeéÿ") for _ in range(rng.randrange(6, 10))) for _ in range(500)} | {"x" * 300, "x" * 301, "x" * 299 + "y"})
    words += sorted({w[:2] + w[3:] for w in words[::3] if len(w) > 6} - set(words)) + sorted({w[:4] + "z" + w[5:] for w in words[::5]} - set(words))
    words = sorted(set(words))
    count = {w: rng.choice([5, 6, 30, 30, 200]) for w in words}
    got = {r.word: r for r in spelling.near_words(spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)).collect()}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        if not near:
            assert w not in got
            continue
        best = min(near, key=lambda v: (-count[v], v))
        assert (got[w].n_near, got[w].near, got[w].near_n) == (len(near), best, count[best])


def test_chains_of_forms_end_at_their_root(spark):
    words = [("abcdef", 5), ("abcdeg", 25), ("abcdhg", 125), ("abcihg", 625), ("abjihg", 3125), ("akjihg", 15625), ("zzzzzz", 9)]
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert all(got[w].root == "akjihg" for w, _ in words[:-1]) and got["zzzzzz"].root == "zzzzzz"
    assert got["abcdef"].form == "abcdeg" and got["akjihg"].form is None


def test_a_box_is_never_closer_than_it_seems():
    rng = np.random.default_rng(11)
    counts = rng.integers(0, 4, (400, spelling._LETTERS)).astype(np.int32) * (np.arange(spelling._LETTERS) < 7)
    tree = spelling.grow(counts, 5, lambda: 0)
    for less, more in ((1, 1), (0, 1), (0, 0)):
        reached = defaultdict(set)
        for leaf, index in spelling.leaves_reached(tree, counts, less, more):
            for q in index.tolist():
                reached[q].update(leaf.points.tolist())
        for q in range(0, 400, 7):
            gap = counts - counts[q]
            close = np.flatnonzero((np.maximum(-gap, 0).sum(1) <= less) & (np.maximum(gap, 0).sum(1) <= more))
            assert set(close.tolist()) <= reached[q]


def test_long_texts_take_time_in_proportion(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choice("abcd") for _ in range(5)) for _ in range(60_000)) + " " + PASSAGE + " again" * 20_000, "en", "a") for k in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.QUERIES["op12_decontamination"](spark, str(tmp_path)).collect()
    assert [(r.n_words, r.n_hit >= 20_012) for r in got] == [(80_012, True)] * 2
