"""Token-ID output: fixed-width bit packing.

Ids take the fewest bits that hold the vocabulary, least bit first, in blocks of
``BLOCK_IDS`` ids that each begin at a byte.  A file is

    magic "GLPACK01", bits u32, ids a block u32 | blocks |
    block offsets i64 (one more than blocks) | doc ids i64, null flags u8,
    doc starts i64 (one more than docs) | sizes and places of these tables | magic

so a reader finds any document's blocks from the tables alone and unpacks them
with a few numpy operations.  Files hold documents in ascending id order, and so
does the sequence of files.

A task writes under a name of its own and lists it in its result; only listed
files count, so a task that runs again leaves nothing that is read.

Defined cases: a null or empty text has the end id alone; a null id sorts first;
equal ids are ordered by text, one entry each; empty tables give no file; very
long texts are read whole, a batch at a time; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_map, shared_path, stash, texts_only

MAGIC = b"GLPACK01"
BLOCK_IDS = 8192
_TAIL = struct.Struct("<qqqqqqI")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids, `bits` each, least bit first."""
    n = len(ids)
    if not n:
        return b""
    ids = ids.astype(np.uint64)
    place = np.arange(n, dtype=np.int64) * bits
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    out = np.zeros(int(n * bits + 63 >> 6) + 1, dtype=np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.add.reduceat(ids << shift, first)
    over = np.flatnonzero((place & 63) + bits > 64)
    out[word[over] + 1] |= ids[over] >> (np.uint64(64) - shift[over])
    return out.tobytes()[: (n * bits + 7) // 8]


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a block."""
    if not n:
        return np.zeros(0, dtype=np.uint32)
    words = np.frombuffer(raw + bytes(16 - len(raw) % 8), dtype="<u8")
    place = np.arange(n, dtype=np.int64) * bits
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    out = words[word] >> shift
    out |= np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint32)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + uri if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


class Writer:
    """Writes one file, block by block; its tables are 17 bytes a document and 8 a block."""

    def __init__(self, uri: str, bits: int):
        fs, path = filesystem(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.bits = fs.open_output_stream(path), bits
        self.out.write(MAGIC + struct.pack("<II", bits, BLOCK_IDS))
        self.at, self.blocks, self.rest = 16, [16], np.zeros(0, dtype=np.uint32)
        self.docs, self.nulls, self.starts, self.n = [], [], [np.zeros(1, np.int64)], 0

    def _put(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.out.write(raw)
        self.at += len(raw)
        self.blocks.append(self.at)

    def add(self, docs: np.ndarray, nulls: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        """Documents with all their ids in one array, and where in it each one's ids end."""
        self.docs.append(docs.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.starts.append(self.n + ends.astype(np.int64))
        self.n += len(ids)
        held = np.concatenate((self.rest, ids.astype(np.uint32)))
        full = len(held) // BLOCK_IDS * BLOCK_IDS
        for a in range(0, full, BLOCK_IDS):
            self._put(held[a : a + BLOCK_IDS])
        self.rest = held[full:]

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._put(self.rest)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        tables = [np.array(self.blocks, dtype="<i8").tobytes(), docs.tobytes(), (np.concatenate(self.nulls) if self.nulls else np.zeros(0, np.uint8)).tobytes(), np.concatenate(self.starts).astype("<i8").tobytes()]
        places = np.cumsum([self.at, *map(len, tables)])[:4].tolist()
        for x in tables:
            self.out.write(x)
        self.out.write(_TAIL.pack(self.n, len(docs), *places, 0) + MAGIC)
        self.out.close()
        return len(docs), self.n


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size, tail = self.file.size(), _TAIL.size + 8
        head, end = self._read(0, 16), self._read(size - tail, tail)
        if head[:8] != MAGIC or end[-8:] != MAGIC:
            raise ValueError(f"not a whole packed file: {uri}")
        self.bits, self.block_ids = struct.unpack("<II", head[8:])
        self.n, self.n_docs, blocks, docs, nulls, starts, _ = _TAIL.unpack(end[:-8])
        self.blocks = np.frombuffer(self._read(blocks, docs - blocks), "<i8")
        self.docs = np.frombuffer(self._read(docs, nulls - docs), "<i8")
        self.nulls = np.frombuffer(self._read(nulls, starts - nulls), np.uint8).astype(bool)
        self.starts = np.frombuffer(self._read(starts, size - tail - starts), "<i8")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first:last, reading only the blocks that hold them."""
        if first >= last:
            return np.zeros(0, dtype=np.uint32)
        a, b = first // self.block_ids, (last - 1) // self.block_ids + 1
        raw = self._read(int(self.blocks[a]), int(self.blocks[b] - self.blocks[a]))
        base, parts = int(self.blocks[a]), []
        for i in range(a, b):
            n = min(self.block_ids, self.n - i * self.block_ids)
            parts.append(unpack(raw[int(self.blocks[i]) - base : int(self.blocks[i + 1]) - base], n, self.bits))
        return np.concatenate(parts)[first - a * self.block_ids : last - a * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


_CACHED_WORDS = 1_500_000
_NEW_WORDS = 100_000
_ENCODED_AT_ONCE = 4096


class _Known:
    """Sorted hashes of words, and where each one's ids lie."""

    def __init__(self, hashes=None, where=None, size=None):
        none = np.zeros(0, np.int64)
        self.hashes = none.astype(np.uint64) if hashes is None else hashes
        self.where, self.size = (none, none) if where is None else (where, size)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self):
            return np.full(len(wanted), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def with_more(self, other: _Known) -> _Known:
        hashes = np.concatenate((self.hashes, other.hashes))
        order = np.argsort(hashes, kind="stable")
        return _Known(hashes[order], np.concatenate((self.where, other.where))[order], np.concatenate((self.size, other.size))[order])


class Encoder:
    """A tokenizer that encodes each distinct word once, as long as its cache has room.

    The vocabulary's normaliser and splitter never let a token cross ASCII white
    space, so a text's ids are its words' ids.  Words are known by their 64-bit
    hash; the cache is two sorted arrays of hashes, the new ones apart until they
    are many, and one array of ids, about 40 bytes a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.old, self.new = _Known(), _Known()
        self.held, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        sizes, parts = [], []
        for a in range(0, len(words), _ENCODED_AT_ONCE):  # the library's results are large
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[a : a + _ENCODED_AT_ONCE]], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            parts.append(np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(sizes[-1].sum())))
        size, ids = np.concatenate(sizes), np.concatenate(parts)
        if self.used + len(ids) > len(self.held):
            grown = np.zeros((self.used + len(ids)) * 3 // 2, np.uint32)
            grown[: self.used] = self.held[: self.used]
            self.held = grown
        self.held[self.used : self.used + len(ids)] = ids
        self.new = self.new.with_more(_Known(hashes, self.used + np.cumsum(size) - size, size))
        self.used += len(ids)
        if len(self.new) > _NEW_WORDS:
            self.old, self.new = self.old.with_more(self.new), _Known()

    def _places(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word lie and how many they are; -1 for words that are not known."""
        where, size = np.full(len(distinct), -1, dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        for known in (self.old, self.new):
            at = known.find(distinct)
            there = at >= 0
            where[there], size[there] = known.where[at[there]], known.size[at[there]]
        return where, size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, an end id after each, and where each text's ids end."""
        words = K.split_words(texts, K.NON_SPACE, lower=False)
        distinct, first, code = np.unique(K.hash_words(words), return_index=True, return_inverse=True)
        if len(self.old) + len(self.new) > _CACHED_WORDS:
            self._forget()
        where, size = self._places(distinct)
        fresh = where < 0
        if fresh.any():
            rows = np.sort(first[fresh])
            spelt = K.spans(words.data, words.starts[rows], words.ends[rows]).to_pylist()
            self._learn(spelt, K.hash_spans(words.data, words.starts[rows], words.ends[rows]))
            where, size = self._places(distinct)
        n = size[code]
        upto = np.concatenate(([0], np.cumsum(n)))
        ends = upto[words.bounds[1:]] + np.arange(1, len(words.bounds))  # with one end id for each text
        out = np.full(int(upto[-1]) + len(texts), end_id, dtype=np.uint32)
        put = np.ones(len(out), dtype=bool)
        put[ends - 1] = False
        out[put] = self.held[np.arange(int(upto[-1])) + np.repeat(where[code] - upto[:-1], n)]
        return out, ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, out_dir: str | None = None) -> DataFrame:
    """Encode all texts and write them; returns the files in order: part, path, n_docs, n_ids, base (ids of all files before)."""
    spark = docs.sparkSession
    where = out_dir or shared_path(spark, "packed")
    bits = bits_for(max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, path, writer = TaskContext.get().partitionId(), "", None
        for batch in batches:
            for piece in K.bites(batch, "text", 4 << 20):
                if writer is None:
                    path = f"{where}/part-{part:06d}-{uuid.uuid4().hex}.pack"
                    writer = Writer(path, bits)
                ids, ends = encoder(tokenizer).encode(piece.column("text"), end_id)
                doc = piece.column("doc_id")
                writer.add(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), ends, ids)
        if writer is not None:
            n_docs, n = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n]})

    ordered = texts_only(docs, "doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = stash(arrow_map(ordered, run, "part long, path string, n_docs long, n_ids long"), "files").orderBy("part").collect()  # one row a file
    rows, base = [], 0
    for f in files:
        rows.append((f["part"], f["path"], f["n_docs"], f["n_ids"], base))
        base += f["n_ids"]
    return spark.createDataFrame(rows, "part long, path string, n_docs long, n_ids long, base long")


def read(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                r, a = Reader(path), 0
                while a < r.n_docs:  # documents of about a million ids at a time
                    b = max(a + 1, int(np.searchsorted(r.starts, r.starts[a] + (1 << 20), side="right")) - 1)
                    raw, first = r.ids(int(r.starts[a]), int(r.starts[b])).astype("<u4").tobytes(), int(r.starts[a])
                    cut = (4 * (r.starts[a : b + 1] - first)).tolist()
                    view = memoryview(raw)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r.docs[a:b], pa.int64(), mask=r.nulls[a:b]), "start": pa.array(base + r.starts[a:b], pa.int64()), "n_tokens": pa.array(np.diff(r.starts[a : b + 1]), pa.int64()), "ids_crc32": pa.array([zlib.crc32(view[x:y]) for x, y in zip(cut, cut[1:])], pa.int64())})
                    a = b

    return arrow_map(files.select("path", "base").repartition(n), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


