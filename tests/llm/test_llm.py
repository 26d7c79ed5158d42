"""Operators of the training-data pipeline against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from compare import differences, duck
from sceneforge.llm import (
    byte_bpe, chat, common, fingerprints, hamming_index, jaccard_join, language_id, letters, packing, queries, repeated_passages, token_files, toxicity, word_pairs,
)

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [
    (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "one", "a"), (4, "one", "a"), (5, "Two words", None), (6, LONG, "b"), (7, LONG, "b"),
    (None, "no id here but some words to see", "a"), (8, "é漢字🙂 <|im_end|> </s>[INST]␛", "c"), (9, "x  y\n\n z ", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    clash = {c: F.lit(c) for c in ("shard", "range", "next", "sketch", "others", "n_words", "lang", "toxicity", "language", "part", "piece", "n_chars")}
    return rows.withColumns(clash)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, spark, sf_dir):
    assert differences(contract.queries()[name](spark, sf_dir), duck(sf_dir), queries.SQL[name]) == []


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in contract.queries()) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in contract.queries()


# 1 packing

def test_packing_keeps_everything_and_its_rules(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    rows = packing.pack(docs, packing.word_count(F.col("text")), F.xxhash64("text"), capacity=512).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    bins, total = defaultdict(list), Counter()
    for r in rows:
        bins[r.shard, r.bin].append(r)
        total[r.doc_id] += r.length
    assert total == {d: len(r.text.encode().split()) for d, r in texts.items()}
    for own in bins.values():
        assert sum(r.length for r in own) == own[0].bin_used <= 512
        assert len({texts[r.doc_id].source for r in own}) == len(own) == len({texts[r.doc_id].text for r in own})
        ends = sorted((r.place, r.place + r.length) for r in own)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_packing_query_keeps_near_copies_apart(spark, tmp_path):
    words = [f"w{k}" for k in range(60)]
    near = [(k, " ".join(words + [f"own{k}"]), f"s{k}") for k in range(5)]
    rows = near + [(10, None, "a"), (10, "", "b"), (None, near[0][1], "c"), (11, "short one", "d"), (11, "short one", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op1_best_fit_packing"](spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    bins = Counter((r.shard, r.bin) for r in got if r.length == 61)
    assert sum(bins.values()) == 6 and set(bins.values()) == {1}


def test_packing_is_best_fit():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    sources, clusters = rng.integers(-1, 6, 300).tolist(), rng.integers(-1, 40, 300).tolist()
    got = packing.pack_shard(lengths, sources, clusters, 100)
    room, held = [], []
    for k, (n, s, c) in enumerate(zip(lengths, sources, clusters)):
        fits = [(room[b], b) for b in range(len(room)) if room[b] >= n and room[b] and not any((s >= 0 and s == x) or (c >= 0 and c == y) for x, y in held[b])]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(100)
            held.append([])
        assert got[k] == (b, 100 - room[b])
        room[b] -= n
        held[b].append((s, c))


def test_packing_of_odd_rows(odd, empty):
    place = lambda df: packing.pack(df, packing.word_count(F.col("text")), F.xxhash64("text"), capacity=2048)
    assert place(empty).count() == 0
    rows = place(odd).collect()
    assert sum(r.length for r in rows) == sum(len((t or "").encode().split()) for _, t, _ in ODD)
    assert sum(r.piece == 0 for r in rows) == len(ODD)


# 2 token files

def test_token_files_round_trip(odd, empty, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    folder, files = token_files.write_tokens(odd, path)
    rows = token_files.read_tokens(folder, files).collect()
    rows.sort(key=lambda r: r.start)
    texts = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [r.doc_id for r in rows] == [d for d, _, _ in texts]
    for r, (_, text, _) in zip(rows, texts):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_tokens(*token_files.write_tokens(empty, path)).count() == 0


def test_added_tokens_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    texts = [f"x {a} y{a}{a}z  w {a[:-1]} {a[1:]}" for a in added] + ["x <|endoftext|>", "<|endoftext|>", "plain words only"]
    expected = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(token_files._Encoder(path).encode(texts)) == expected


def test_words_that_differ_in_punctuation_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, encoder, sent = Tokenizer.from_file(path), token_files._Encoder(path), []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: sent.append(text) or ids(text))
    tails = ["", ".", ",", "...", "'", "''", "!?", "_", "-", "$$$", "'.", ")"]
    texts = ["a " + " ".join("quixotry" + t for t in tails), " ".join("quixotry" + t for t in tails)]
    texts += [f"a{t} don't{t} it's{t} \u00e9t\u00e9{t} 12{t} \u4e2d{t} x\ny{t} x\u00a0{t} \u01c5{t} \u0301{t} {t}s b" for t in tails]
    texts += ["", " ", "a ", " a", "a  b", "a \n b", "a\n b", "\n", "a\nb c\td", "a \x1c b", "a " + "x" * 400 + ". b", "x's. 's 's. s'"]
    assert list(encoder.encode(texts)) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sum(text.count(" quixotry") for text in sent) == 1


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, texts = Tokenizer.from_file(path), ["", "some words, here.", "Some  words\nhere "]
    assert list(token_files._Encoder(path).encode(texts)) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_token_file_reads_one_frame_and_notices_damage():
    class Source(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    out = io.BytesIO()
    data = [np.arange(k, 3 * k, dtype="<u4").tobytes() for k in (1, 500, 0)]
    token_files.write_file(out, iter(zip([3, None, 5], data)))
    file = token_files.TokenFile(Source(out.getvalue()))
    assert file.doc_ids == [3, None, 5] and [file.ids(k).tobytes() for k in range(3)] == data
    broken = bytearray(out.getvalue())
    broken[-9 - 12 * 3 + 8] ^= 1  # the first checksum
    with pytest.raises(ValueError):
        token_files.TokenFile(Source(bytes(broken))).ids(0)


# 3 Jaccard join

def plain_components(rows, width, threshold):
    sets = []
    for _, text in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= threshold * len(a | sets[j]):
                parent[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min((x for x in (low.get(top(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), low[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("long_list", [2, 256])
def test_jaccard_join_equals_all_pairs(spark, sf_dir, odd, monkeypatch, long_list):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard_join, "PART", 7)
    base = "the cat sat on a mat and saw nine more cats on mats of red wool in the old house by the sea".split()
    near = [(100 + k, " ".join(base[:k] + [f"new{k}"] + base[k:])) for k in range(20)]
    rows = [(d, t) for d, t, _ in ODD] + near + [(200 + k, t) for k, (_, t) in enumerate(near[:3])]
    for width, threshold in ((4, 0.6), (5, 0.8)):
        got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, threshold).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, width, threshold)


@pytest.mark.parametrize("long_list", [2, 256])
def test_jaccard_join_links_rows_without_an_id(spark, monkeypatch, long_list):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    words = [f"w{k}" for k in range(100)]
    step = lambda k: " ".join(f"x{j}" if j % 20 == 10 and j < 20 * k else w for j, w in enumerate(words))
    chain = [(1, step(0)), (None, step(1)), (7, step(2)), (None, step(2) + " more"), (None, "nothing like the others at all"), (None, None)]
    frame = spark.createDataFrame(chain + [(None, step(1))], "doc_id long, text string")
    got = jaccard_join.near_duplicates(frame, 5, 0.9).collect()
    plain = plain_components([(r.doc_id, r.text) for r in frame.collect()], 5, 0.9)
    assert sorted((tuple(r) for r in got), key=str) == plain
    assert plain_components([chain[0], chain[2]], 5, 0.9) != [x for x in plain if x[0]]  # the row without an id is the bridge
    texts = [r.text for r in corpus_pipeline.keep_one_of_near_duplicates(spark, frame, "").collect()]
    assert sorted(texts, key=str) == sorted([chain[0][1], chain[4][1], None], key=str)


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in common.components(edges).collect()} == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


# 4 vectors

def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 32))
    near = np.repeat(base[:20], 4, axis=0) + rng.standard_normal((80, 32)) * 0.12
    vectors = [v.tolist() for v in np.vstack((base, near, base[:3]))]
    odd = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32, []]
    rows = list(enumerate(vectors + odd))
    got = {r.vec_id: r for r in hamming_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[k].n_links for k in range(len(vectors))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(len(vectors), len(rows)))
    assert hamming_index.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pairs_meet_once_in_the_first_table_that_has_them_together():
    rng = np.random.default_rng(5)
    codes = [3, 5 | 63 << 6, *rng.integers(0, 1 << 12, 60).tolist()]  # the first two have one bit each that the other lacks
    cut = hamming_index.pieces(12, 2)

    def keys(code, begin, length):
        piece = code >> begin & (1 << length) - 1
        return {piece} | {piece - (1 << b) for b in range(length) if piece >> b & 1}

    expected = [sum(any(keys(a, *c) & keys(b, *c) for c in cut) for j, b in enumerate(codes) if i != j) for i, a in enumerate(codes)]
    found, first_two = np.zeros(len(codes), int), 0
    for table, c in enumerate(cut):
        for key in range(64):
            some = [i for i, code in enumerate(codes) if key in keys(code, *c)]
            own = pa.table({
                "code": pa.array([codes[i] for i in some], pa.int64()), "class_id": pa.array(some, pa.int64()), "copies": [1] * len(some),
                "vector": pa.array([[1.0, 2.0]] * len(some), pa.list_(pa.float64())), "part": [0] * len(some),
            })
            for ids, links, _ in hamming_index._links(own, 12, 2, 0.9, table, key, (0, 0)) if len(some) > 1 else ():
                np.add.at(found, ids, links)
                first_two += {0, 1} <= set(ids.tolist())
    assert found.tolist() == expected and first_two >= 1


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((400, 64))
    noise = rng.standard_normal((1200, 64))
    vectors = np.vstack((base, np.repeat(base, 3, axis=0) + noise * rng.uniform(0.3, 0.5, (1200, 1))))  # cosines of 0.88 to 0.97
    got = hamming_index.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in got.collect()}
    assert links.sum() > 1000 and all(found[k] <= n for k, n in enumerate(links)) and sum(found.values()) >= 0.99 * links.sum()


# 5 repeated passages

def plain_removal(rows):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = b" ".join(w[i:i + 20])
            if key in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(key)
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def test_repeated_passages_equal_plain_removal(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(repeated_passages, "SHARD", 3)
    passage = " ".join(f"p{k}" for k in range(33))
    more = [(50 + k, f"own{k} words {passage} then {'again ' * k}{passage if k % 2 else ''}") for k in range(12)] + [(90, "same " * 300)]
    rows = [(d, t) for d, t, _ in ODD] + more
    got = repeated_passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_removal(rows)
    assert repeated_passages.remove_repeats(empty).count() == 0
    kept = repeated_passages.remove_repeats(odd, verbatim=True).select("doc_id", "kept", "n_removed", "others.shard").collect()
    assert {r.shard for r in kept} == {"shard"} and any(r.kept is None for r in kept)


def test_repeated_passages_gather_no_anchor(spark, monkeypatch):
    monkeypatch.setattr(repeated_passages, "SHARD", 2)
    line = "Licensed under the Apache License Version 2.0 of the year all rights are reserved"
    rows = [(k, " ".join(f"a{k}x{j}" for j in range(15)) + f" {line} " + " ".join(f"b{k}x{j}" for j in range(15))) for k in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(0, 40, 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left = repeated_passages.remove_repeats(frame)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "hashpartitioning(anchor" not in plan
    got = left.select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_removal(rows)


# 6 toxicity

def test_letter_models_are_distributions():
    codes, starts, words = letters.grams([b"Some words here", b"", b"x9 caf\xc3\xa9"])
    assert starts.tolist() == [0, 16, 16, 25] and len(words) == 5
    counts = np.bincount(codes, minlength=letters.SIZE)
    lower = letters.shared_backoff(counts)
    assert np.allclose(lower.sum(axis=1), 1)
    full = letters._interpolated(counts, np.tile(lower, (letters.SYMBOLS, 1)))
    assert np.allclose(full.sum(axis=1), 1) and (full > 0).all()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op6_toxicity"](spark, sf)
    marked = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (marked.predicted == marked.toxic).mean() > 0.93 and marked.score.between(0, 1).all()


def plain_means(marked, texts):
    split = lambda t: ["<s>", *"".join(c if c.isalnum() or c > "\x7f" else " " for c in (t or "")).lower().split(), "</s>"]
    pairs = [Counter(), Counter()]
    for t, label in marked:
        w = split(t)
        pairs[label].update(zip(w, w[1:]))
    discount = lambda c: (lambda a, b: a / (a + 2 * b) if a and b else 0.5)(*(sum(x == k for x in c.values()) for k in (1, 2)))
    kinds = [Counter(w for _, w in p) for p in pairs]
    pooled = Counter(w for _, w in {*pairs[0], *pairs[1]})

    def mixed(counts, x, lower, cut):
        total = sum(counts.values())
        return max(counts[x] - cut, 0) / total + cut * len(counts) / total * lower if total else lower

    def p(k, u, w):
        both = mixed(pooled, w, 1 / (len(pooled) + 1), discount(pooled))
        after = Counter({b: n for (a, b), n in pairs[k].items() if a == u})
        return mixed(after, w, mixed(kinds[k], w, both, discount(kinds[k])), discount(pairs[k]))

    return [np.mean([np.log(p(1, u, w) / p(0, u, w)) for u, w in zip(split(t), split(t)[1:])]) for t in texts]


def test_word_models_equal_plain_kneser_ney(spark):
    rng = np.random.default_rng(8)
    names = ["alpha", "beta", "gäm", "déb", "2001", "2002", "x9"]
    marked = [(" ".join(rng.choice(names, 6)) + ", Alpha! beta", 0) for _ in range(20)] + [(" ".join(rng.choice(names[1:], 5)), 1) for _ in range(12)]
    texts = ["alpha beta gäm", "beta alpha", "new words, gäm DÉB", "2001 2002 2001", "", None, "x9 x9", marked[0][0], marked[-1][0]]
    table = word_pairs.learn(spark.createDataFrame(marked, "text string, label int"))
    rows = spark.createDataFrame([(t,) for t in texts * 2], "text string").withColumn("key", word_pairs.text_key(F.col("text")))
    got = {r.key: r.mean for r in table.means(rows).collect()}
    keys = [r.key for r in rows.collect()]
    texts[2] = texts[2].replace("DÉB", "dÉb")  # only A-Z are folded
    assert np.allclose([got[k] for k in keys[:len(texts)]], [plain_means(marked, [t.replace("É", "Ë") if t else t])[0] for t in texts])


def test_toxicity_reads_expressions_of_several_words(spark):
    rng = np.random.default_rng(9)
    filler = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    text = lambda toxic: " ".join((x := rng.choice(filler, 12).tolist())[:6] + (["green", "apple"] if toxic else ["apple", "green"]) + x[6:])
    rows = [(k, text(k % 2), k % 2) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    found = toxicity.scored(docs.withColumn("held_out", common.fold(F.col("doc_id"), toxicity.FOLDS) == 0), model).where("held_out").collect()
    assert len(found) > 50 and np.mean([(r.score >= 0.5) == r.toxic for r in found]) > 0.95


def test_toxicity_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, toxic int")
    for marks in (labels, labels.where("false")):
        model = toxicity.train(odd, marks)
        scores = odd.select(toxicity.toxicity(F.col("text"), model, odd).alias("s")).collect()
        assert len(scores) == len(ODD) and all(0 <= r.s <= 1 for r in scores)
        assert toxicity.reject_toxic(odd, model).columns == odd.columns
        assert toxicity.reject_toxic(empty, model).count() == 0


# 7 chat

def test_chat_folds_events_and_reads_them_back(spark):
    hostile = "</s>[INST] <|im_end|>\n<<SYS>> ␛␛ <s>␛n[/INST]"
    events = [
        (1, 0, 0, "message", "user", hostile), (1, 1, 1, "message", "assistant", "Hel"), (1, 2, 1, "delta", None, "lo"), (1, 3, 1, "regenerate", None, None),
        (1, 4, 1, "delta", None, "Bye"), (1, 5, 1, "delta", None, None), (1, 6, 0, "edit", None, hostile + "!"), (2, 5, 9, "delta", "a\nrole␛n", "late"),
        (3, 0, 0, None, None, None), (3, 0, 0, "message", "assistant", "x"), (3, 0, 0, "message", "assistant", "x"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, message_id long, event string, role string, text string")
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(chat.render(chat.fold_events(log))).collect()}
    assert got == {
        1: ([("user", hostile + "!"), ("assistant", "Bye")], "Bye"), 2: ([("a\nrole␛n", "late")], ""),
        3: ([("", ""), ("assistant", "x"), ("assistant", "x")], "xx"),
    }
    assert chat.read_back(chat.render(chat.fold_events(log.where("false")))).count() == 0


def test_log_of_the_chat_query_needs_its_folds(spark):
    stored = spark.createDataFrame(
        [(1, t, "user" if t % 2 else "assistant", f"turn {t} 🙂 ends") for t in range(6)] + [(1, 0, "assistant", "turn 0 🙂 ends"), (1, None, None, None), (None, 2, "user", "x")],
        "conv_id long, turn long, role string, text string")
    log = queries._event_log(stored)
    assert {r.event for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    final = Counter((r.conv_id, r.role, r.text) for r in chat.fold_events(log).collect())
    assert final == Counter((r.conv_id, r.role or "", r.text or "") for r in stored.collect())
    for kind in ("delta", "edit", "regenerate"):
        assert Counter((r.conv_id, r.role, r.text) for r in chat.fold_events(log.where(F.col("event") != kind)).collect()) != final


# 8 language

def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op8_language_id"](spark, sf).join(common.documents(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95


def test_language_of_odd_rows(odd, empty):
    for learned in (language_id.train(odd), language_id.train(empty)):
        found = odd.select("text", language_id.language(F.col("text"), learned, odd).alias("f")).collect()
        for r in found:
            if not learned.languages or not any(map(str.isalpha, r.text or "")):
                assert r.f.lang_pred == "und" and r.f.score == 0
        assert language_id.reject_unclear(empty, learned).columns == empty.columns


# 9 fingerprints

def test_fingerprints_follow_neighbours(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 16)
    docs = common.documents(spark, sf_dir)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    for k, (d, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(k + 1) % len(rows)]
        edited = text[:len(text) - half] + after[1][:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[d].fingerprint == got[after[0]].fingerprint) >= (text == after[1])


def test_sketches_merge_and_estimate(spark):
    words = [f"w{k}" for k in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    row = spark.range(1).select(
        *(fingerprints.sketch(fingerprints.shingle_hashes(F.lit(t))).alias(c) for c, t in (("a", a), ("b", b), ("none", ""))),
    ).select(
        "a", fingerprints.resemblance(F.col("a"), F.col("b")).alias("near"), fingerprints.containment(F.col("a"), F.col("b")).alias("inside"),
        fingerprints.distinct_shingles(fingerprints.merge(F.col("a"), F.col("b"))).alias("all"), fingerprints.resemblance(F.col("none"), F.col("none")).alias("same"),
        fingerprints.resemblance(F.col("none"), F.col("a")).alias("nothing"),
    ).first()
    assert len(row.a) == fingerprints.K and abs(row.near - 1 / 3) < 0.15 and abs(row.inside - 0.5) < 0.2 and abs(row["all"] / 2992 - 1) < 0.3
    assert (row.same, row.nothing) == (1, 0)


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fingerprints.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and fingerprints.fingerprints(empty).count() == 0
    assert len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1


# 10 byte-level BPE

def test_byte_bpe_equals_tiktoken(odd, empty, spark, sf_dir):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(20, "a" * 700), (21, "ab" * 500 + " " * 300 + "12345678 don't I'LL")]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).union(common.documents(spark, sf_dir).select("doc_id", "text").limit(40))
    texts = Counter((r.doc_id, r.text or "") for r in rows.collect())
    got = byte_bpe.encode_documents(rows, ranks, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in got) == texts
    assert all(r.ids == plain.encode_ordinary(bytes(r.decoded).decode()) for r in got)
    assert byte_bpe.encode_documents(empty, ranks, public_tokenizers.PATTERN).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in byte_bpe.encode_documents(blank, ranks, public_tokenizers.PATTERN).collect()} == {(1, (), b""), (2, (), b"")}
    assert spark.range(1).select(byte_bpe.decode_ids(F.array(F.lit(72), F.lit(10**6)), ranks).alias("x")).first().x is None


def test_byte_bpe_passes_words_in_small_rows(spark):
    spelled = {f"w{k}" + "x" * (200 if k % 1000 == 7 else 0): k for k in range(5000)}
    batches = list(byte_bpe._block([1, None], [np.arange(5000, dtype=np.int32), np.zeros(0, np.int32)], spelled))
    words = [len(w) for batch in batches for w in batch.column("words").to_pylist() if w is not None]
    assert sum(words) == 5000 and max(words) <= byte_bpe.ROW
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {k: " ".join(f"{'qz' * 90 if j % 997 == 3 else ''}{chr(97 + j % 26)}{j}{chr(98 + j % 25)}é" for j in range(k, k + 3000)) for k in range(4)}
    got = byte_bpe.encode_documents(spark.createDataFrame(list(text.items()), "doc_id long, text string").coalesce(1), ranks, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: (r.ids, bytes(r.decoded).decode()) for r in got} == {k: (plain.encode_ordinary(t), t) for k, t in text.items()}


def test_order_of_shingles_is_that_of_two_keys():
    rng = np.random.default_rng(4)
    for low in (0, 1 << 60):
        keys, owner = rng.integers(low, low + 200, 3000).astype(np.uint64), rng.integers(0, 9, 3000)
        assert (jaccard_join._order(keys, owner) == np.lexsort((keys, owner))).all()
        order = jaccard_join._order(keys, owner, repeated=True)
        assert (np.diff(owner[order]) >= 0).all() and (keys[order] == keys[np.lexsort((keys, owner))]).all()
    assert len(jaccard_join._order(keys[:0], owner[:0])) == 0
    many = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert (jaccard_join._order(many, owner := rng.integers(0, 300, 100_000)) == np.lexsort((many, owner))).all()


def test_word_count_equals_the_expression(odd, empty, spark):
    texts = [None, "", " ", "a", " a", "a ", "é b", "a\tb\x0bc\x0cd\re\nf", "x" * 3_000_000 + " y", "one", "two", "a\xa0b c\x1fd", "\x85 z"]
    rows = odd.select("text").union(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    assert rows.select(packing.word_count(F.col("text")).alias("x"), plain.alias("y")).where("x IS NULL OR x <> y").count() == 0
    assert empty.select(packing.word_count(F.col("text"))).count() == 0


def test_texts_meet_labels_as_in_a_join(spark):
    texts = spark.createDataFrame([(k % 70 if k % 9 else None, f"t{k}", k % 5) for k in range(300)], "doc_id long, text string, part long")
    marks = spark.createDataFrame([(k, k % 2) for k in range(0, 90, 2)] + [(4, 1), (6, 0), (6, 0), (None, 1)], "doc_id long, label int")
    rows = lambda df: Counter(df.select("doc_id", "text", "part", "label").collect())
    plain, bits = rows(texts.join(marks, "doc_id")), toxicity.word_pairs.FILTER_BITS
    for toxicity.word_pairs.FILTER_BITS in (7, bits):  # few places: most ids share theirs
        found = toxicity._marked(texts, marks)
        assert rows(found) == plain
    assert rows(toxicity._marked(texts, marks.withColumn("doc_id", F.col("doc_id").cast("int")))) == plain


def test_ngrams_of_a_span_travel_once():
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(400)), "text": ["same words in every text", "and some more"] * 200})
    spans = list(word_pairs._spans(batch))
    assert sum(s.num_rows for s in spans) == 400
    rows = sum(b.num_rows for b in word_pairs._postings(batch, 0, np.full(1 << (word_pairs.FILTER_BITS - 6), -1)))
    assert rows < 400 + 50  # the mark of the start for each text, anything else once


# the pipeline

def test_pipeline_stages(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "near_duplicates":
            groups = plain_components([(d, r.text) for d, r in before.items()], 5, 0.8)
            assert set(after) == {d for d, _, low in groups if d == low}
        elif name == "repeated_passages":
            plain = {d: (gone, kept) for d, _, gone, kept in plain_removal([(d, r.text) for d, r in before.items()])}
            assert {d: r.text for d, r in after.items()} == {d: kept if gone else before[d].text for d, (gone, kept) in plain.items()}
        else:
            assert set(after) <= set(before) and len(after) > 0.75 * len(before)
            assert all(before[d] == r for d, r in after.items())
        docs = out
    assert {r.doc_id for r in corpus_pipeline.pack_documents(spark, docs, sf_dir).collect()} == {r.doc_id for r in docs.collect()}
