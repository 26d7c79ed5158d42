"""Byte-level BPE by Spark higher-order functions.

``encode_words`` is a column expression: it folds the ranked merges over the bytes
of a word, looking pairs of tokens up in a literal rank map. Documents are grouped
into blocks of numbered words; each block's distinct words are encoded once and
documents are put together from them. A block is many rows in the order of their
partition: its words, ``ROW`` at a time, and then its documents. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 32 << 20
"""Text a block holds; a longer text is a block of its own."""
_SHIFT = 17
_NONE = 1 << _SHIFT
"""More than any rank."""
_SPREAD = (2654435761, 2246822519)
_DROP = 15
CACHE = 500_000
"""Stretches of text a worker remembers."""
SLICE = 1 << 18
"""Words whose pieces are gathered at once."""
ROW = 2048
"""Words that one row holds; a row of all of a block's words would be copied whole by every expression."""
LONG = 128
"""Bytes of a word up to which merges are folded by scanning it."""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _literal(text: str, kind: str) -> Column:
    return F.from_json(F.lit(text), kind)


def _merge_table(ranks: dict[bytes, int]) -> tuple[list[int], int]:
    """Ranks of all pairs of tokens that merge, in an open-addressed table, and the most places a search looks at.

    An entry is left << 34 | right << 17 | rank, and -1 where there is none.
    """
    pairs = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append((left, right, rank))
    slots = 1 << max(8, (4 * len(pairs)).bit_length())
    table, most = [-1] * slots, 0
    for left, right, rank in pairs:
        at = (left * _SPREAD[0] + right * _SPREAD[1] >> _DROP) & (slots - 1)
        looked = 1
        while table[at] >= 0:
            at, looked = (at + 1) % slots, looked + 1
        table[at] = left << (2 * _SHIFT) | right << _SHIFT | rank
        most = max(most, looked)
    return table, most


def byte_array(word: Column) -> Column:
    """A binary column as an array of its bytes."""
    letters = F.decode(word, "ISO-8859-1")  # a character for each byte
    found = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.ascii(F.substring(letters, i, F.lit(1))))
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(found)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of words, as the ranks merge them: always the pair of least rank, the first of them in a tie.

    ``words`` is an array of words, each an array of bytes. The state of the fold
    over a word has a number for each token: the rank it merges to with the next
    one, and its id. A null word stays null; one without bytes has no ids.
    """
    if max(ranks.values()) >= _NONE:
        raise ValueError(f"ranks have to be below {_NONE}")
    table, most = _merge_table(ranks)
    slots = len(table)
    single = _literal("[" + ",".join(str(ranks[bytes([b])]) for b in range(256)) + "]", "array<long>")

    def encode_with(merges: Column, alone: Column) -> Column:
        def with_next(left: Column, right: Column) -> Column:
            """A token's number, before another or before the end (null)."""
            key = left * _NONE + right
            at = F.shiftright(left * _SPREAD[0] + right * _SPREAD[1], _DROP).bitwiseAND(F.lit(slots - 1)).cast("int")
            found = F.when(right.isNull(), F.lit(_NONE).cast("long"))
            for k in range(most):
                entry = F.get(merges, at if k == 0 else (at + k).bitwiseAND(F.lit(slots - 1)))
                found = found.when(entry < 0, F.lit(_NONE).cast("long")).when(F.shiftright(entry, _SHIFT) == key, entry.bitwiseAND(F.lit(_NONE - 1)))
            return found.otherwise(F.lit(_NONE).cast("long")) * _NONE + left

        token = lambda number: number.bitwiseAND(F.lit(_NONE - 1).cast("long"))

        def step(state: Column, _: Column) -> Column:
            def merge(rank: Column, at: Column) -> Column:  # at: place of the left one, from 0
                after = lambda i: token(F.get(state, i))
                changed = F.transform(state, lambda number, i: F.when(i == at, with_next(rank, after(at + 2)))
                                      .when(i == at - 1, with_next(token(number), rank)).otherwise(number))
                return F.filter(changed, lambda _, i: i != at + 1)

            place = lambda rank: (F.array_position(F.transform(state, lambda number: F.shiftright(number, _SHIFT)), rank) - 1).cast("int")
            least = lambda rank: F.when(rank >= _NONE, state).otherwise(_bound(place(rank), lambda at: merge(rank, at)))
            return _bound(F.shiftright(F.array_min(state), _SHIFT), least)

        def encode(word: Column) -> Column:
            ids = F.transform(word, lambda b: F.get(alone, b.cast("int").bitwiseAND(F.lit(255))))
            start = _bound(ids, lambda own: F.transform(own, lambda left, i: with_next(left, F.get(own, i + 1))))
            folded = F.aggregate(F.slice(word, F.lit(2), F.size(word)), start, step, lambda state: F.transform(state, token))
            return F.when(F.size(word) < 2, ids).otherwise(folded)

        return F.transform(words, encode)

    merges = _literal("[" + ",".join(map(str, table)) + "]", "array<long>")
    return _bound(merges, lambda m: _bound(single, lambda one: encode_with(m, one)))


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of an array of ids: their pieces one after the other. Null stays null, an unknown id makes null."""
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = _literal("[" + ",".join("null" if p is None else f'"{p}"' for p in pieces) + "]", "array<string>")
    found = F.transform(ids, lambda i: F.get(table, i.cast("int")))
    return F.when(~F.exists(found, lambda p: p.isNull()), F.unhex(F.array_join(found, "")))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a word of any length, with a heap instead of a scan for each of them."""
    parts: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(ranks[p], i, p) for i in range(len(word) - 1) if (p := word[i:i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(word) or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j], after[i] = joined, None, after[j]
        if after[i] < len(word):
            before[after[i]] = i
            if (p := joined + parts[after[i]]) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if before[i] >= 0 and (p := parts[before[i]] + joined) in ranks:
            heapq.heappush(heap, (ranks[p], before[i], p))
    return [ranks[p] for p in parts if p is not None]


class _Numbered:
    """Numbers of the words that texts are made of; stretches between single spaces that came before are looked up."""

    def __init__(self, pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        self.known: dict[str, list[int] | None] = {}

    def _numbers(self, text: str) -> list[int]:
        return [self.words.setdefault(w, len(self.words)) for w in self.find(text)]

    def _plain(self, part: str) -> bool:
        return bool(part) and not part[0].isspace() and not part[-1].isspace()

    def __call__(self, text: str) -> np.ndarray:
        parts = text.split(" ")
        if not self._plain(parts[0]):  # runs of white space depend on what follows them
            return np.array(self._numbers(text), np.int32)
        if len(self.known) > CACHE:
            self.known.clear()
        for part in set(parts[1:]).difference(self.known):
            self.known[part] = self._numbers(" " + part) if self._plain(part) else None
        found = [self.known[part] for part in parts[1:]]
        if None in found:
            return np.array(self._numbers(text), np.int32)
        found.insert(0, self._numbers(parts[0]))
        return np.fromiter(chain.from_iterable(found), np.int32)


class _Pieces:
    """What the words of a block become, end to end, and where each begins."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        self.begins = np.cumsum(sizes) - sizes

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The pieces of these words, one after the other."""
        sizes = self.sizes[numbers]
        place = np.repeat(self.begins[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return self.values[place + np.arange(len(place))]

    def of_long(self, numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([self.of(numbers[k:k + SLICE]) for k in range(0, len(numbers), SLICE)] or [self.values[:0]])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists and the lists' sizes."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], np.diff(offsets).astype(np.int64)


def _filled(values: np.ndarray, sizes: np.ndarray, places: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of lists, of which those at ``places`` were empty and become ``parts``."""
    lengths = np.array([len(p) for p in parts])
    begins = np.repeat((np.cumsum(sizes) - sizes)[places], lengths)
    sizes = sizes.copy()
    sizes[places] = lengths
    return np.insert(values, begins, np.concatenate(parts)), sizes


def _letters(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words and the words' sizes."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(words.to_pylist()), np.uint8), sizes


def _lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def _block(ids: list[int | None], texts: list[np.ndarray], spelled: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The spelling of each word, some words a row, then the documents as numbers of words. ``words`` has nothing for words in ``long``."""
    coded: list[bytes] = []
    for word in chain(spelled, (None,)):
        if word is None or len(coded) == ROW:
            short = [w if len(w) <= LONG else b"" for w in coded]
            longer = [k for k, w in enumerate(coded) if len(w) > LONG]
            words = _lists(pa.array(np.frombuffer(b"".join(short), np.int8)), [len(w) for w in short])
            yield pa.RecordBatch.from_arrays([
                pa.array([False]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), _lists(words, [len(words)]),
                _lists(pa.array(longer, pa.int32()), [len(longer)]), _lists(pa.array([coded[k] for k in longer], pa.binary()), [len(longer)]),
            ], _NAMES)
            coded = []
        if word is not None:
            coded.append(word.encode())
    for begin in range(0, len(ids), DOCUMENTS):
        some = texts[begin:begin + DOCUMENTS]
        empty = (pa.nulls(len(some), kind) for kind in (pa.list_(pa.list_(pa.int8())), pa.list_(pa.int32()), pa.list_(pa.binary())))
        yield pa.RecordBatch.from_arrays([
            pa.array([True] * len(some)), pa.array(ids[begin:begin + DOCUMENTS], pa.int64()),
            _lists(pa.array(np.concatenate(some)), [len(t) for t in some]), *empty,
        ], _NAMES)


_NAMES = ["is_document", "doc_id", "numbers", "words", "long_numbers", "long"]
_BLOCK = "is_document boolean, doc_id long, numbers array<int>, words array<array<tinyint>>, long_numbers array<int>, long array<binary>"
DOCUMENTS = 64
"""Documents that are put together at once."""


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text, and the bytes that its ids stand for: doc_id, ids, decoded.

    Each match of ``pattern`` is a word of its own. A null text counts as empty.
    Rows come back as often as they came in; a null id stays null. Words of over
    LONG bytes are merged by ``merge_long``. Further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, number = [], [], 0, _Numbered(pattern)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                texts.append(number(text))
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield from _block(ids, texts, number.words)
                    ids, texts, held, number = [], [], 0, _Numbered(pattern)
        if ids:
            yield from _block(ids, texts, number.words)

    def encoded_words(rows: list[pa.RecordBatch]) -> tuple[_Pieces, _Pieces]:
        """Ids and bytes of all words of a block."""
        coded, coded_sizes, letters, letter_sizes = [], [], [], []
        for batch in rows:
            for row in range(batch.num_rows):
                long_numbers, long, ids, decoded = (batch.column(c)[row].values for c in ("long_numbers", "long", "ids", "decoded"))
                own, own_sizes = _flat(ids)
                own_letters, own_letter_sizes = _letters(decoded)
                places, merged = long_numbers.to_numpy(), [merge_long(w, ranks) for w in long.to_pylist()]
                if merged:  # the fold had nothing for these words
                    own, own_sizes = _filled(own, own_sizes, places, [np.array(m, np.int32) for m in merged])
                    spelled = [np.frombuffer(b"".join(bytes_of[i] for i in m), np.uint8) for m in merged]
                    own_letters, own_letter_sizes = _filled(own_letters, own_letter_sizes, places, spelled)
                coded.append(own.astype(np.int32))
                coded_sizes.append(own_sizes)
                letters.append(own_letters)
                letter_sizes.append(own_letter_sizes)
        none = np.zeros(0, np.int64)
        whole = lambda parts, kind: np.concatenate([none.astype(kind), *parts])
        return _Pieces(whole(coded, np.int32), whole(coded_sizes, np.int64)), _Pieces(whole(letters, np.uint8), whole(letter_sizes, np.int64))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []  # words of the block whose documents follow
        pieces = texts = None
        for batch in batches:
            is_document = batch.column("is_document").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(is_document[1:] != is_document[:-1]) + 1).tolist(), batch.num_rows]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                if not is_document[first]:
                    rows.append(batch.slice(first, last - first))
                    continue
                if rows:
                    pieces, texts = encoded_words(rows)
                    rows = []
                for begin in range(first, last, DOCUMENTS):
                    some = batch.slice(begin, min(DOCUMENTS, last - begin))
                    numbers, sizes = _flat(some.column("numbers"))
                    bounds = np.concatenate(([0], np.cumsum(sizes)))
                    spans = [numbers[x:y] for x, y in zip(bounds, bounds[1:])]
                    out_ids = [pieces.of_long(span) for span in spans]
                    yield pa.RecordBatch.from_arrays([
                        some.column("doc_id"), _lists(pa.array(np.concatenate(out_ids)), [len(x) for x in out_ids]),
                        pa.array([texts.of_long(span).tobytes() for span in spans], pa.binary()),
                    ], ["doc_id", "ids", "decoded"])

    bytes_of = {rank: token for token, rank in ranks.items()}
    encoded = rows.mapInArrow(gather, _BLOCK).withColumn("ids", encode_words(F.col("words"), ranks))
    encoded = encoded.withColumn("decoded", F.transform("ids", lambda i: decode_ids(i, ranks))).drop("words")
    return encoded.mapInArrow(put_together, "doc_id long, ids array<int>, decoded binary")
