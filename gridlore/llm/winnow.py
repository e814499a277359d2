"""Benchmark decontamination by winnowing.

A text's fingerprints are the least k-gram hashes of its sliding windows of
``window`` words (k-grams of 5 words, 9 of them a window of 13).  Two texts that
share a window select the same k-gram inside it, so joining fingerprints finds
every shared window; each hit is then extended word by word, and counts only if
``window`` words or more agree.  An item of fewer words is one window of its own
length, for which every gram of that length is a fingerprint.

Sizes: fingerprints of documents are filtered through a bitmap of the items'
fingerprints, whose size is fixed, before they leave their task; then Spark
joins them, by broadcast or shuffle as sizes allow.

Defined cases: null or empty texts have no words and no hits; an item without
words has no window; repeated rows of documents are judged each on its own,
repeated item ids count once, a null item id is the empty text in lists; empty
tables give no hits or no rows; very long texts are read whole; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_map, lean, packed, row_ids, stash, texts_only, unpacked

GRAM = 5
BITMAP_BITS = 24
_FOUND = "uid long, doc_id long, text_hash long, n_words long, tag array<int>, pos array<long>, fp array<long>, context array<binary>"


def _select(g: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash (the first of equals) of each window of grams."""
    if not len(starts):
        return starts
    least, at = g[starts], np.zeros(len(starts), dtype=np.int64)
    for j in range(1, width):
        other = g[starts + j]
        less = other < least
        least = np.where(less, other, least)
        at[less] = j
    mark = np.zeros(len(g), dtype=bool)
    mark[starts + at] = True
    return np.flatnonzero(mark)


def fingerprints(bounds: np.ndarray, h: np.ndarray, window: int, k: int, short: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(tag, places, fingerprints): tag 0 for winnowed k-grams, else the length of a short item's only window."""
    out = []
    g = K.hash_grams(h, k)
    at = _select(g, K.grams_inside(bounds, window), window - k + 1)
    out.append((0, at, g[at]))
    for size in short:
        at = K.grams_inside(bounds, size)
        out.append((size, at, K.mix(K.hash_grams(h, size)[at] ^ np.uint64(size))))
    return out


def _context(h: np.ndarray, bounds: np.ndarray, doc: np.ndarray, at: np.ndarray, before: int, size: int) -> np.ndarray:
    """Hashes of the words around each place, 0 beyond its document."""
    idx = at[:, None] + np.arange(-before, size - before)[None, :]
    ok = (idx >= bounds[doc][:, None]) & (idx < bounds[doc + 1][:, None])
    return np.where(ok, h[np.clip(idx, 0, max(len(h) - 1, 0))], np.uint64(0)) if len(at) else np.zeros((0, size), dtype=np.uint64)


def _word_hashes(words: K.Words) -> np.ndarray:
    h = K.hash_words(words)
    h[h == 0] = 1
    return h


def _scan(texts: DataFrame, window: int, k: int, short: list[int], bitmap) -> DataFrame:
    """One row a text with those of its fingerprints that the (broadcast) bitmap holds."""
    around = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits = row_ids(), bitmap.value
        for batch in batches:
            for part in K.bites(batch, "text"):
                words = K.split_words(part.column("text"), K.ALNUM, lower=True)
                h, bounds, sizes = _word_hashes(words), words.bounds, np.diff(words.bounds)
                owner = words.docs()
                tags, docs, places, prints, contexts = [], [], [], [], []
                for tag, at, fp in fingerprints(bounds, h, window, k, short):
                    if len(fp):
                        slot = fp >> np.uint64(64 - BITMAP_BITS)
                        there = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                        at, fp = at[there == 1], fp[there == 1]
                    doc = owner[at]
                    around_it = _context(h, bounds, doc, at, 0 if tag else around, tag or k + 2 * around)
                    raw = around_it.tobytes()
                    wide = 8 * around_it.shape[1]
                    tags.append(np.full(len(at), tag, dtype=np.int32))
                    docs.append(doc)
                    places.append(at - bounds[doc])
                    prints.append(fp.view(np.int64))
                    contexts += [raw[i * wide : (i + 1) * wide] for i in range(len(at))]
                doc = np.concatenate(docs)
                order = np.argsort(doc, kind="stable")
                cut = pa.array(np.searchsorted(doc[order], np.arange(len(sizes) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, x.take(pa.array(order))) for x in (pa.array(np.concatenate(tags)), pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(prints)), pa.array(contexts, pa.binary()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(ids) for _ in sizes], pa.int64()), part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()), *lists],
                    ["uid", "doc_id", "text_hash", "n_words", "tag", "pos", "fp", "context"],
                )

    return arrow_map(texts, run, _FOUND)


def _flat(found: DataFrame) -> DataFrame:
    return found.select("uid", "doc_id", F.explode(F.arrays_zip("tag", "pos", "fp", "context")).alias("x")).select("uid", "doc_id", "x.*")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """2 ** BITMAP_BITS bits that hold every fingerprint; at most 2 ** (BITMAP_BITS - 6) rows come to the driver, however many items there are."""
    slot = F.shiftrightunsigned("fp", 64 - BITMAP_BITS)
    rows = prints.select(F.shiftrightunsigned(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITMAP_BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return bits


def _extend(pairs: DataFrame, window: int, k: int) -> DataFrame:
    """The doc words on which a hit and the item agree, where they are a whole window or more."""
    around = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tag, pos = batch.column("tag").to_numpy(), batch.column("pos").to_numpy()
            ours, theirs = batch.column("context"), batch.column("item_context")
            for t in np.unique(tag):
                rows = np.flatnonzero(tag == t)
                take = pa.array(rows)
                a, b = (np.frombuffer(b"".join(x.take(take).to_pylist()), dtype="<u8").reshape(len(rows), -1) for x in (ours, theirs))
                same = (a == b) & (a != 0)
                if t:
                    good, start, end = same.all(axis=1), pos[rows], pos[rows] + t
                else:
                    left = np.cumprod(same[:, :around][:, ::-1], axis=1).sum(axis=1)
                    right = np.cumprod(same[:, around + k :], axis=1).sum(axis=1)
                    good = same[:, around : around + k].all(axis=1) & (left + k + right >= window)
                    start, end = pos[rows] - left, pos[rows] + k + right
                kept = rows[good]
                yield pa.RecordBatch.from_pydict({"uid": batch.column("uid").take(pa.array(kept)), "context_id": batch.column("context_id").take(pa.array(kept)), "first": pa.array(start[good], pa.int64()), "last": pa.array(end[good], pa.int64())})

    return arrow_map(pairs.select("uid", "tag", "pos", "context", "item_context", "context_id"), run, "uid long, context_id binary, first long, last long")


def _merged(hits: DataFrame) -> DataFrame:
    """uid, n_hit and spans of the words that the hits (uid, first, last) cover: sorted, and opened anew where a hit starts after the end of all before it."""
    by_place = Window.partitionBy("uid").orderBy("first", "last")
    new = F.coalesce(F.col("first") > F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    run = F.sum(F.col("new").cast("int")).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    spans = hits.withColumn("new", new).withColumn("run", run).groupBy("uid", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return spans.groupBy("uid").agg(F.sum(F.col("last") - F.col("first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, k: int = GRAM) -> DataFrame:
    """One row a document: doc_id, text_hash, n_words, n_hit, item_ids (sorted texts), spans (merged, in words).

    items: item_id and text.
    """
    spark = docs.sparkSession
    theirs = stash(_item_prints(items, window, k), "items")
    short = [r["tag"] for r in theirs.filter("tag > 0").select("tag").distinct().collect()]  # at most window - 1 of them
    bits = spark.sparkContext.broadcast(_bitmap(theirs))
    found = stash(_scan(texts_only(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text")), window, k, sorted(short), bits), "found")
    contexts = theirs.select("tag", "fp", F.col("context").alias("item_context"), "context_id").distinct()
    hits = _extend(_flat(found).join(contexts, ["tag", "fp"]), window, k)
    hits = stash(hits, "hits")
    spans = _merged(hits.select("uid", "first", "last").distinct())
    named = hits.select("uid", "context_id").distinct().join(theirs.select("context_id", "item").distinct(), "context_id").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    return (
        found.select("uid", "doc_id", "text_hash", "n_words")
        .join(spans, "uid", "left")
        .join(named, "uid", "left")
        .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans")
    )


def _item_prints(items: DataFrame, window: int, k: int) -> DataFrame:
    """tag, fp, context, context_id and the item's id as text, a row for each fingerprint of an item."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = window - k
        for batch in batches:
            for part in K.bites(batch, "text"):
                words = K.split_words(part.column("text"), K.ALNUM, lower=True)
                h, bounds, sizes, owner = _word_hashes(words), words.bounds, np.diff(words.bounds), words.docs()
                for tag, at, fp in fingerprints(bounds, h, window, k, sorted({int(x) for x in sizes if 0 < x < window})):
                    if tag:
                        whole = sizes[owner[at]] == tag
                        at, fp = at[whole], fp[whole]
                    if len(at):
                        raw = _context(h, bounds, owner[at], at, 0 if tag else around, tag or k + 2 * around)
                        yield pa.RecordBatch.from_pydict({"item": part.column("item").take(pa.array(owner[at])), "tag": pa.array(np.full(len(at), tag, np.int32)), "fp": fp.view(np.int64), "context": pa.array([x.tobytes() for x in raw], pa.binary())})

    return arrow_map(named, run, "item string, tag int, fp long, context binary").withColumn("context_id", F.unhex(F.sha2(F.concat(F.col("tag").cast("string").cast("binary"), "context"), 256)))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, k: int = GRAM) -> DataFrame:
    """The rows of docs that are not contaminated: a row goes if a twentieth of its words or more are hit."""
    bad = contamination(docs, items, window, k).filter("n_hit > 0 AND 20 * n_hit >= n_words").select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_bad_hash")).distinct()
    here = F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_hash") == F.col("_bad_hash"))
    return unpacked(packed(docs).join(lean(bad, "contaminated"), here, "left_anti"), docs)
