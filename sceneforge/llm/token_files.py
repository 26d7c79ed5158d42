"""Token ids in binary files of independent zstandard frames.

A file holds one frame per document with its ids as little-endian unsigned 32-bit
integers, and two skippable frames after them: the document ids (64-bit, with a
byte each that says whether it is null), and the seek table. The seek table lists
compressed size, size and checksum of each frame, ends with the number of frames,
a descriptor and the magic number of the seekable format, and lies at the very
end. Any zstandard decoder reads a file from front to back; ``TokenFile`` reads the
end first and decompresses requested documents only.
"""

from __future__ import annotations

import functools
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sceneforge.session import scratch_path, write_out

LEVEL = 3
_SKIPPABLE_IDS, _SKIPPABLE_SEEK, _SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_CHECKSUMS = 0x80
CACHE = 500_000
"""Words a tokenizing worker remembers."""


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def write_file(out, documents: Iterator[tuple[int | None, bytes]]) -> list[tuple[int | None, int]]:
    """Write frames and tables to a binary stream; the id and size of every document."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    entries, ids, nulls, written = [], [], [], []
    for doc_id, data in documents:
        frame = packer.compress(data)
        out.write(frame)
        entries.append(struct.pack("<III", len(frame), len(data), checksum(data)))
        ids.append(struct.pack("<q", doc_id or 0))
        nulls.append(b"\1" if doc_id is None else b"\0")
        written.append((doc_id, len(data)))
    names = b"".join(ids + nulls)
    out.write(struct.pack("<II", _SKIPPABLE_IDS, len(names)) + names)
    table = b"".join(entries) + struct.pack("<IBI", len(entries), _CHECKSUMS, _SEEKABLE)
    out.write(struct.pack("<II", _SKIPPABLE_SEEK, len(table)) + table)
    return written


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != _SEEKABLE or descriptor != _CHECKSUMS:
            raise ValueError("not a token file")
        begin = size - 9 - 12 * frames
        table = np.frombuffer(self._read(begin, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.sizes, self.sums = table.T
        self.offsets = np.concatenate(([0], np.cumsum(self.packed)))
        names = self._read(int(self.offsets[-1]) + 8, 9 * frames)
        nulls = np.frombuffer(names, np.uint8, frames, 8 * frames)
        self.doc_ids = [None if n else d for d, n in zip(np.frombuffer(names, "<i8", frames).tolist(), nulls.tolist())]
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def _read(self, begin: int, size: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(size)

    def ids(self, number: int) -> np.ndarray:
        """Token ids of a document by its place in the file; an error if they are damaged."""
        data = self.unpacker.decompress(self._read(int(self.offsets[number]), int(self.packed[number])), max_output_size=max(1, int(self.sizes[number])))
        if len(data) != self.sizes[number] or checksum(data) != self.sums[number]:
            raise ValueError(f"checksum of document {self.doc_ids[number]} differs")
        return np.frombuffer(data, "<u4")


_SPACE, _LONG = "\u0120", 256
"""How a byte-level vocabulary spells a space, and characters up to which words are encoded together."""


def _plain(word: str) -> bool:
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


def _stem(word: str) -> str:
    """``word`` without ASCII punctuation after a last Latin letter: the tokenizer begins a new piece between them."""
    stem = word.rstrip(string.punctuation)
    return stem if stem and stem[-1].isalpha() and stem[-1] < "\u0250" else word


class _Encoder:
    """Ids of texts. Text is cut at single spaces between other characters, where a byte-level tokenizer always begins a
    new piece; what stands between them is encoded once, with the space before it. Other tokenizers get whole texts."""

    def __init__(self, tokenizer_file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        parts = self.tokenizer.pre_tokenizer
        self.cuts = isinstance(parts, pre_tokenizers.ByteLevel) and parts.use_regex and not parts.add_prefix_space and self.tokenizer.normalizer is None
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.known: dict[str, bytes] = {}  # empty: a run of white space, whose text is encoded whole
        self.heads: dict[str, bytes] = {}  # words that begin a text, and punctuation
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[number for token, number in vocabulary.items() if token.startswith(_SPACE)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _head(self, word: str) -> bytes:
        if word not in self.heads:
            self.heads[word] = self._ids(word).tobytes()
        return self.heads[word]

    def _learn(self, words: set[str]) -> None:
        """Encode words, without the punctuation behind them, in one go, parted at the tokens that begin with a space; long ones alone."""
        stems = {}
        for word in words:
            if not _plain(word):
                self.known[word] = b""
            elif len(word) > _LONG:
                self.known[word] = self._ids(" " + word).tobytes()
            else:
                stems[word] = _stem(word)
        joined = list(set(stems.values()).difference(self.known))
        for begin in range(0, len(joined), 2048):
            some = joined[begin:begin + 2048]
            ids = self._ids(" " + " ".join(some))
            cuts = (4 * np.flatnonzero(self.begins[ids])).tolist()
            if len(cuts) != len(some):
                raise ValueError("the tokenizer does not part words at white space")
            data = ids.tobytes()
            for stem, first, last in zip(some, cuts, [*cuts[1:], len(data)]):
                self.known[stem] = data[first:last]
        for word, stem in stems.items():
            if len(stem) < len(word):
                self.known[word] = self.known[stem] + self._head(word[len(stem):])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        # runs of white space are the tokenizer's to cut, and so are texts that spell one of its added tokens
        cut = [t.split(" ") if self.cuts and not self.added.search(t) else None for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        if len(self.heads) > CACHE // 10:
            self.heads.clear()
        found = [list(map(self.known.get, words[1:])) if words else [] for words in cut]
        self._learn({word for words, ids in zip(cut, found) if None in ids for word, one in zip(words[1:], ids) if one is None})
        for text, words, ids in zip(texts, cut, found):
            if None in ids:
                ids = [self.known[word] if one is None else one for word, one in zip(words[1:], ids)]
            if words is None or not _plain(words[0]) or b"" in ids:
                yield self._ids(text).tobytes()
            else:
                yield self._head(words[0]) + b"".join(ids)


@functools.cache
def _encoder(tokenizer_file: str) -> _Encoder:
    """One a worker, so that tasks share what it remembers."""
    return _Encoder(tokenizer_file)


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Tokenize all texts and write their ids, each document's followed by ``end_id``, in ascending order of document.

    Returns the folder, under the shared folder of the session, and a written table
    (file, part, documents, tokens); files in the order of ``part`` hold the
    documents in ascending order, null ids first. Null texts count as empty; equal
    ids lie next to each other. A file gets its name when it is complete, and a
    task that is run again writes the same file.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_file)

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                texts = batch.column("text").fill_null("")
                for begin in range(0, len(ids), 512):
                    some = texts.slice(begin, 512).to_pylist()
                    for doc_id, data in zip(ids[begin:begin + 512], encoder.encode(some)):
                        yield doc_id, data + end

        store.create_dir(root, recursive=True)
        draft, name = f"{root}/_{uuid.uuid4().hex}", f"{root}/part-{part:06d}.ids.zst"
        with store.open_output_stream(draft, buffer_size=1 << 20) as out:
            written = write_file(out, documents())
        store.move(draft, name)
        yield pa.RecordBatch.from_pydict({
            "file": [name], "part": pa.array([part], pa.int32()), "documents": [len(written)], "tokens": [sum(n for _, n in written) // 4],
        })

    return folder, write_out(rows.mapInArrow(run, "file string, part int, documents long, tokens long"), "files")


def read_tokens(folder: str, files: DataFrame) -> DataFrame:
    """Read files back, checksums compared: doc_id, start, n_tokens, ids_crc32, file, number."""
    spark = files.sparkSession
    tasks = max(1, files.count())
    spread = files.select("file", "part").repartition(tasks, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, part in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist()):
                with store.open_input_file(name) as source:
                    file = TokenFile(source)
                    sums = [zlib.crc32(file.ids(k).tobytes()) for k in range(len(file))]
                counts = file.sizes // 4
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(file.doc_ids, pa.int64()), "begin": np.cumsum(counts) - counts, "n_tokens": counts,
                    "ids_crc32": pa.array(sums, pa.int64()), "part": pa.array([part] * len(file), pa.int32()), "number": np.arange(len(file)),
                })

    rows = spread.mapInArrow(run, "doc_id long, begin long, n_tokens long, ids_crc32 long, part int, number long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = files.select("part", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", "file", "number")
