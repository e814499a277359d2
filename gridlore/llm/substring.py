"""Removal of repeated byte strings, exact over the whole corpus, by suffix arrays of shards.

Removes every byte that a string of ``window`` bytes covers which also starts
anywhere else.  Sorting all suffixes of the corpus in one order needs all text
in one place, so the corpus is sharded first such that no repeat crosses shards:

1. Each window has an anchor chosen by content alone (``anchors``); equal windows
   have equal anchors at equal places.  The stretches of windows with one anchor
   are counted by anchor gram and content.  A gram that occurs once has no
   repeated window; all windows of a stretch that occurs twice are repeated.
2. The distinct stretches of grams that have several are dealt out by gram, the
   bytes of each from one document, which brings all equal windows together.  A gram with more than ``GRAM_BYTES`` is
   dealt again, by the anchor's place in the window and by the window's last
   bytes, in which equal windows agree as well.  Each task sorts the suffixes of
   its stretches, packed together, by induced sorting, computes the permuted
   common prefixes, and marks windows that share ``window`` bytes with a
   neighbour.
3. Marked spans go back to the documents that hold the stretches; texts that
   lose some of their bytes are read again and cut.

Equal texts are worked on once a task (their first two count).  Fixed-size
bitmaps keep stretches that cannot matter from being shuffled; they never decide.

Defined cases: null and empty texts have no bytes; texts shorter than the window
lose nothing; repeated rows are copies of each other (whole texts of ``window``
bytes or more go); a null id is an id; empty tables give no rows; long texts are
worked on whole, in overlapping pieces; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors, suffix
from . import kernels as K
from .common import arrow_map, discard, grouped, lean, stash

BITMAP_BITS = 26
PACK_BYTES = 2 << 20
#: bytes of the stretches of one gram beyond which it is dealt again
GRAM_BYTES = 16 << 20


def _unseen(batch: pa.RecordBatch, seen: dict[int, int], most: int) -> pa.RecordBatch:
    """Rows whose text this task has met fewer than `most` times."""
    rows = []
    for i, key in enumerate(batch.column("key").to_pylist()):
        if seen.get(key, 0) < most:
            seen[key] = seen.get(key, 0) + 1
            rows.append(i)
    return batch if len(rows) == batch.num_rows else batch.take(pa.array(rows, pa.int64()))


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - BITMAP_BITS)
    return ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)) == 1


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A fixed number of bits that holds every value of the long column h."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
        for batch in batches:
            slot = batch.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
            np.bitwise_or.at(bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        for i, piece in enumerate(bits.reshape(64, -1)):
            if piece.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int64()), "bits": pa.array([piece.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("piece").to_pylist(), batch.column("bits").to_pylist()):
                held[i] = held[i] | np.frombuffer(raw, dtype="<u8") if i in held else np.frombuffer(raw, dtype="<u8")
        for i, piece in held.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int64()), "bits": pa.array([piece.tobytes()], pa.binary())})

    schema = "piece long, bits binary"
    out = np.zeros((64, 1 << (BITMAP_BITS - 12)), dtype=np.uint64)
    rows = arrow_map(arrow_map(hashes.select("h"), mark, schema).repartition(16, "piece"), merge, schema).toArrow()
    for i, raw in zip(rows.column("piece").to_pylist(), rows.column("bits").to_pylist()):
        out[i] = np.frombuffer(raw, dtype="<u8")
    return out.reshape(-1)


def _short(key: np.ndarray) -> np.ndarray:
    """A text's key in 32 bits, to tell the documents of one content apart."""
    return (key.view(np.uint64) >> np.uint64(32)).astype(np.int64)


def _grams(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """gram, content, n, least short key and size of the stretches of a batch, of equal texts the first two a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for part in K.bites(_unseen(batch, seen, 2), "text"):
                found = anchors.stretches(*K.flat(part.column("text")), window, gram)
                key = _short(part.column("key").to_numpy())[found.doc]
                order = np.lexsort((key, found.content))
                content = found.content[order]
                first = np.flatnonzero(np.append(True, content[1:] != content[:-1])) if len(order) else order
                yield pa.RecordBatch.from_pydict(
                    {"gram": found.gram[order][first].view(np.int64), "content": content[first].view(np.int64), "n": np.diff(np.append(first, len(order))).astype(np.int32), "short": key[order][first], "size": found.size[order][first].astype(np.int32)}
                )

    return arrow_map(texts, run, "gram long, content long, n int, short long, size int")


def _occurrences(texts: DataFrame, window: int, gram: int, live, chosen) -> DataFrame:
    """Where stretches of grams that may repeat lie, once for equal texts of a task; and the bytes of a content in the document chosen for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for part in K.bites(_unseen(batch, seen, 1), "text"):
                data, offsets = K.flat(part.column("text"))
                found = anchors.stretches(data, offsets, window, gram)
                keep = np.flatnonzero(_has(live.value, found.gram))
                doc, content = found.doc[keep], found.content[keep]
                key = part.column("key").to_numpy()
                mine = np.flatnonzero(_has(chosen.value, content ^ _short(key)[doc].view(np.uint64)))
                mine = mine[np.unique(content[mine], return_index=True)[1]]
                raw: list[bytes | None] = [None] * len(keep)
                for k in mine.tolist():
                    i = keep[k]
                    raw[k] = data[found.at[i] : found.at[i] + found.size[i]].tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": key[doc],
                        "n_bytes": np.diff(offsets)[doc],
                        "first": pa.array(found.first[keep], pa.int64()),
                        "size": pa.array(found.size[keep].astype(np.int32)),
                        "gram": pa.array(found.gram[keep].view(np.int64), mask=np.array([r is None for r in raw], dtype=bool)),
                        "content": content.view(np.int64),
                        "anchor": pa.array(found.anchor[keep].astype(np.int32)),
                        "bytes": pa.array(raw, pa.binary()),
                    }
                )

    return arrow_map(texts, run, "key long, n_bytes long, first long, size int, gram long, content long, anchor int, bytes binary")


_SPANS = "content long, low array<int>, high array<int>"


def _spans_of(starts: np.ndarray, size: int, window: int) -> tuple[list[int], list[int]]:
    """Bytes that the windows at these starts cover."""
    a, b = K.runs(K.cover(size, starts, window))
    return a.tolist(), b.tolist()


_PIECES = "gram long, content long, shift int, bytes binary"


def _dealt_again(window: int, gram: int):
    """Pieces of the stretches of crowded grams: windows whose anchor lies in the same part of them, under a gram of their own.

    `ways` says into how many shards the gram goes: first by the place of the
    anchor, as far as there are places, then, window by window, by its last bytes.
    """
    places = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("gram", "content", "shift", "bytes")}
            for code, content, anchor, ways, raw in zip(*(batch.column(c).to_pylist() for c in ("gram", "content", "anchor", "ways", "bytes"))):
                parts, count = min(ways, places), len(raw) - window + 1
                # the window that starts at w has its anchor at place anchor - w
                part = (anchor - np.arange(count)) * parts // places
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), count]
                for a, b in zip(cuts, cuts[1:]):
                    piece = raw[a : b + window - 1]
                    key = f"{code}:{parts}:{part[a]}".encode()
                    if parts < ways:
                        key += b":" + str(zlib.crc32(piece[-16:]) % -(-ways // places)).encode()
                    for c, v in zip(out, (int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True), content, a, piece)):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=list(out))

    return run


def _sort_shards(window: int, gram: int):
    most = 2 * window - gram + 1  # bytes that a stretch can cover

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        names: list[tuple[int, int]] = []
        waiting = 0

        def solved():
            got = {}
            for name, t, at in zip(names, texts, suffix.repeated(texts, window, most)):
                if len(at):
                    got[name] = [[x + name[1] for x in side] for side in _spans_of(at, len(t), window)]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.array([g[0] for g in got.values()], pa.list_(pa.int32())), pa.array([g[1] for g in got.values()], pa.list_(pa.int32()))], names=["content", "low", "high"])

        for _, rows in grouped(batches, "gram"):
            whole = dict(zip(zip(rows.column("content").to_pylist(), rows.column("shift").to_pylist()), rows.column("bytes").to_pylist()))
            if len(whole) < 2:
                continue
            texts += whole.values()
            names += whole
            waiting += sum(map(len, whole.values()))
            if waiting > PACK_BYTES:
                yield solved()
                texts, names, waiting = [], [], 0
        if texts:
            yield solved()

    return run


def _merged(places: DataFrame) -> DataFrame:
    """key, low and high of its merged spans, n_removed, n_spans and whether they are all of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("key", "low", "high", "n_removed", "n_spans", "whole")}
            for key, n, low, high in zip(*(batch.column(c).to_pylist() for c in ("key", "n_bytes", "low", "high"))):
                order = np.argsort(low, kind="stable")
                low, reach = np.array(low)[order], np.maximum.accumulate(np.array(high)[order])
                new = np.flatnonzero(np.append(True, low[1:] > reach[:-1]))
                low, high = low[new], reach[np.append(new[1:] - 1, len(reach) - 1)]
                gone = int((high - low).sum())
                for c, v in zip(out, (key, low, high, gone, len(low), gone == n)):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["low"], pa.list_(pa.int64())), pa.array(out["high"], pa.list_(pa.int64())), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["whole"], pa.bool_())], names=list(out))

    return arrow_map(places.select("key", "n_bytes", "low", "high"), run, "key long, low array<long>, high array<long>, n_removed long, n_spans long, whole boolean")


def _cut(texts: DataFrame) -> DataFrame:
    """key, kept and kept_sha256 of texts with their merged spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, low, high in zip(*(batch.column(c).to_pylist() for c in ("text", "low", "high"))):
                raw = text.encode()
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *high], [*low, len(raw)])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["key", "kept", "kept_sha256"])

    return arrow_map(texts.select("key", "text", "low", "high"), run, "key long, kept binary, kept_sha256 string")


def _only(texts: DataFrame, bits) -> DataFrame:
    """Distinct texts of a task whose key the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            there = batch.filter(pa.array(_has(bits.value, batch.column("key").to_numpy().view(np.uint64))))
            yield _unseen(there, seen, 1)

    return arrow_map(texts, run, "key long, text string")


def removed(docs: DataFrame, window: int = 200, gram: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes, null: all) and kept_sha256 of every row. gram: bytes, a multiple of 8, at most window.

    A longer gram means fewer chance meetings of unequal stretches and more stretches.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = keyed.select("key", "text")
    counted = _grams(texts, window, gram).repartition("gram").groupBy("gram", "content").agg(F.sum("n").alias("n"), F.min("short").alias("short"), F.first("size").alias("size"))
    own = Window.partitionBy("gram")
    ways = F.greatest(F.lit(1), F.ceil(F.sum("size").over(own) / GRAM_BYTES)).cast("int")
    counted = counted.withColumns({"contents": F.count("*").over(own), "total": F.sum("n").over(own), "ways": ways}).filter("total > 1").drop("total", "size")
    counted = stash(counted, "counted")
    share = spark.sparkContext.broadcast
    live = share(_bitmap(counted.select(F.col("gram").alias("h"))))
    chosen = share(_bitmap(counted.filter("contents > 1").select(F.col("content").bitwiseXOR(F.col("short")).alias("h"))))
    found = stash(_occurrences(texts, window, gram, live, chosen), "stretches")
    crowded = lean(counted.filter("ways > 1 AND contents > 1").select("gram", "ways").distinct(), "crowded")
    met = found.filter("bytes IS NOT NULL").select("gram", "content", "anchor", "bytes").join(crowded, "gram", "left")
    plain = met.filter("ways IS NULL").select("gram", "content", F.lit(0).alias("shift"), "bytes")
    again = arrow_map(met.filter("ways IS NOT NULL"), _dealt_again(window, gram), _PIECES)
    shards = plain.unionByName(again).repartition("gram").sortWithinPartitions("gram")
    sorted_out = arrow_map(shards, _sort_shards(window, gram), _SPANS)
    twice = counted.filter("n > 1").select("content", F.array(F.lit(0)).alias("low"), F.lit(None).cast("array<int>").alias("high"))
    places = found.select("key", "n_bytes", "first", "size", "content").join(twice.unionByName(sorted_out), "content")
    places = places.select("key", "n_bytes", "first", F.explode(F.arrays_zip("low", F.coalesce("high", F.array("size")).alias("high"))).alias("x"))
    spans = places.groupBy("key").agg(F.first("n_bytes").alias("n_bytes"), F.collect_set(F.struct((F.col("first") + F.col("x.low")).alias("low"), (F.col("first") + F.col("x.high")).alias("high"))).alias("s"))
    spans = stash(_merged(spans.select("key", "n_bytes", "s.low", "s.high")), "spans")
    discard(found, counted, crowded)
    partly = spans.filter("NOT whole")
    cut = _cut(_only(texts, share(_bitmap(partly.select(F.col("key").alias("h"))))).dropDuplicates(["key"]).join(partly, "key"))
    nothing = hashlib.sha256(b"").hexdigest()
    changed = spans.select("key", "n_removed", "n_spans", "whole").join(cut, "key", "left")
    rows = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("_sha"))
    zero = F.lit(0).cast("long")
    return rows.join(changed, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.when(F.col("whole"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("whole"), nothing).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
    )
