"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Target words of each source: its weight's share of all words, at most
   ``most`` times what it has, the excess shared again by weight.
2. Documents fall into bins and, within a bin, into at most ``BLOCKS`` blocks a
   source, by a keyed hash of id and text.  Bins hold about ``BIN_WORDS`` words,
   so their number follows the input and one bin is a bounded task; a source with
   few words lies in few bins, so that its blocks stay small against its quota.
3. A bin's share of a source's target is a whole number of block draws: as many
   full passes as fit, then blocks in a keyed permutation that fit into what is
   left.
4. Within a bin a binary tree over its output shards splits the vector of quotas
   exactly: at each node the left half's share is one multivariate-hypergeometric
   draw, seeded by the bin and the node's place, so every rerun draws the same.
5. Each shard takes the next of its quota in the permuted order of each source's
   draws, so shards hold disjoint draws, and orders its rows by a hash.

What reaches the driver is a row a source; weights are a setting, so is their
number.  Everything a document needs is joined by (source, bin, block), so a
source with a third of all rows is spread over its blocks.

Defined cases: a null or empty text has size 0 and counts for nothing; null is a
source, the last; a null id is an id; rows that are alike in source, id and text
are taken alike, and count each; empty tables give no rows; long texts are
counted whole; extra columns are carried by ``mix`` only.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stash

#: blocks of a source in one bin
BLOCKS = 1024
BIN_WORDS = 1 << 28
#: words of a source in one bin, on average, below which it lies in fewer bins
SOURCE_BIN_WORDS = 1 << 22
#: sources whose blocks may all lie in one bin
BIN_SOURCES = 256
SHARD_WORDS = 2_000_000
#: partitions that mix() writes at most; beyond, a partition holds several shards
MOST_PARTITIONS = 100_000
_BROADCAST_ROWS = 200_000


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = 3) -> list[Fraction]:
    """Each source's words: by weight, none above `most` times its size."""
    total, held = sum(sizes), [None] * len(sizes)
    while True:
        free = [i for i, t in enumerate(held) if t is None]
        weight = sum(weights[i] for i in free)
        left = total - sum(t for t in held if t is not None)
        over = [i for i in free if Fraction(left * weights[i], weight) > most * sizes[i]]
        if not over:
            return [Fraction(left * weights[i], weight) if t is None else t for i, t in enumerate(held)]
        for i in over:
            held[i] = Fraction(most * sizes[i])


def split(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each shard from each source, (shards, sources): columns sum to the quotas, rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            out[low] = own
            continue
        mid, total = (low + high) // 2, int(own.sum())
        share = total * (mid - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(own, share, method="marginals")
        todo += [(low, mid, left), (mid, high, own - left)]
    return out


def choose(words: np.ndarray, order: np.ndarray, want: Fraction, most: int) -> np.ndarray:
    """Copies of each block that come to about `want` words: passes over all of them, then blocks, in their order, that fit into the rest."""
    size = int(words.sum())
    passes = min(most, int(want // size)) if size else 0
    copies = np.full(len(words), passes, dtype=np.int64)
    if passes >= most:
        return copies
    left, out = want - passes * size, []
    for i in order.tolist():
        w = int(words[i])
        if not w:
            continue
        if w <= left:
            copies[i] += 1
            left -= w
        else:
            out.append((w, i))
    # the least block that is left over comes in where that ends nearer
    if out and abs(min(out)[0] - left) < left:
        copies[min(out)[1]] += 1
    return copies


def _deal(target: dict[int, tuple[int, int]], held: dict[int, int], most: int, shards: int, seed: int):
    """target: exact words of each source, as numerator and denominator; held: what it has."""

    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        """Copies of the blocks of one bin and the shards they go to: draws, pass after pass and each in the permuted order, go to the shards by their quotas."""
        bin_no = int(key[0])
        blocks = blocks.sort_values(["source_no", "rank", "block"], kind="stable", ignore_index=True)
        parts = []
        for no, part in blocks.groupby("source_no", sort=True):
            words = part["words"].to_numpy()
            want = Fraction(*target[int(no)]) * int(words.sum()) / max(1, held[int(no)])
            copies = choose(words, np.arange(len(words)), want, most)
            keep = copies > 0
            parts.append((int(no), part["block"].to_numpy()[keep], copies[keep]))
        cuts = np.cumsum(split([int(c.sum()) for _, _, c in parts], shards, seed + 7919 * bin_no), axis=0)
        out = []
        for k, (no, block, copies) in enumerate(parts):
            if not len(block):
                continue
            row = np.repeat(np.arange(len(block)), copies)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            order = np.lexsort((row, turn))
            shard = np.empty(len(row), dtype=np.int64)
            shard[order] = np.searchsorted(cuts[:, k], np.arange(len(row)), side="right") + bin_no * shards
            lists = [np.sort(p).tolist() for p in np.split(shard, np.cumsum(copies)[:-1])]
            out.append(pd.DataFrame({"source_no": no, "bin": bin_no, "block": block, "copies": copies, "shards": pd.Series(lists, dtype=object)}))
        return pd.concat(out) if out else pd.DataFrame({"source_no": [], "bin": [], "block": [], "copies": [], "shards": pd.Series([], dtype=object)})

    return run


def sized(docs: DataFrame, seed: int, *carry: str) -> DataFrame:
    """doc_id, source, size and a keyed hash of every document, and what else is asked for."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words.alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"),
        *carry,
    )


def _placed(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows with source_no, bin and block; numbers: _name, source_no, first_bin and bins of each source, and the number of all bins."""
    spread = F.pmod(F.shiftrightunsigned("h", 32), F.col("bins"))
    named = rows.join(numbers, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    return named.withColumns({"bin": F.pmod(F.col("first_bin") + spread, F.col("all_bins")).cast("int"), "block": F.pmod(F.col("h"), F.lit(BLOCKS)).cast("int")}).drop("first_bin", "bins", "all_bins")


def _numbers(spark: SparkSession, named: list[tuple], bins: int, seed: int) -> DataFrame:
    rows = []
    for name, no, words, _ in named:
        first = zlib.crc32(f"{seed}:{no}".encode()) % bins
        rows.append((name, no, first, max(1, min(bins, words // SOURCE_BIN_WORDS)), bins))
    table = spark.createDataFrame(rows, "_name string, source_no int, first_bin long, bins long, all_bins long")
    return F.broadcast(table) if len(rows) <= _BROADCAST_ROWS else table


@dataclass
class Plan:
    numbers: DataFrame  # where the documents of each source lie
    chosen: DataFrame  # source_no, bin, block, copies, shards
    named: list[tuple]  # source, its number, size and target
    shards: int


def plan(counted: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, shards: int | None = None, seed: int = 20) -> Plan:
    spark = counted.sparkSession
    rows = [(r["source"], int(r["n"])) for r in counted.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    want = targets([n for _, n in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
    named = [(s, i, n, float(t)) for i, ((s, n), t) in enumerate(zip(rows, want))]
    total = sum(n for _, n in rows)
    bins = max(1, -(-total // BIN_WORDS), -(-len(rows) // BIN_SOURCES))
    per_bin = -(-shards // bins) if shards else max(1, -(-total // (bins * SHARD_WORDS)))
    numbers = _numbers(spark, named, bins, seed)
    blocks = _placed(counted, numbers).groupBy("source_no", "bin", "block").agg(F.sum("size").alias("words")).withColumn("rank", F.xxhash64(F.lit(seed + 1), "source_no", "bin", "block"))
    exact = {i: (t.numerator, t.denominator) for i, t in enumerate(want)}
    deal = _deal(exact, {i: n for i, (_, n) in enumerate(rows)}, most, per_bin, seed)
    dealt = blocks.groupBy("bin").applyInPandas(deal, "source_no int, bin int, block int, copies long, shards array<int>")
    return Plan(numbers, stash(dealt, "plan"), named, bins * per_bin)


def _taking(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    if chosen.count() <= _BROADCAST_ROWS:  # of a few dozen bytes each
        chosen = F.broadcast(chosen)
    return placed.join(chosen, ["source_no", "bin", "block"], "left")


def shares(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, shards: int | None = None, seed: int = 20) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words, repeats counted) and shards of every document."""
    counted = stash(sized(docs, seed), "sized")
    done = plan(counted, weights, most, shards, seed)
    about = docs.sparkSession.createDataFrame([(i, n, t) for _, i, n, t in done.named], "source_no int, source_size long, target double")
    if len(done.named) <= _BROADCAST_ROWS:
        about = F.broadcast(about)
    got = _taking(_placed(counted, done.numbers), done.chosen).join(about, "source_no")
    copies = F.when(F.col("size") > 0, F.coalesce("copies", F.lit(0))).otherwise(0)
    return got.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), F.when(copies > 0, F.col("shards")).alias("shards"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, shards: int | None = None, seed: int = 20) -> DataFrame:
    """The rows that the mix takes, repeats as repeated rows, with all columns of docs; a partition a shard, shuffled within each."""
    counted = stash(sized(docs, seed), "sized")
    done = plan(counted, weights, most, shards, seed)
    discard(counted)
    columns = list(docs.columns)
    row = sized(docs, seed, F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    taken = _taking(_placed(row, done.numbers), done.chosen).filter("size > 0 AND copies > 0").select("_row", "h", F.posexplode("shards").alias("_turn", "_shard"))
    parts = min(done.shards, MOST_PARTITIONS)
    taken = taken.repartitionById(parts, F.pmod(F.col("_shard"), F.lit(parts)).cast("int")).sortWithinPartitions("_shard", F.xxhash64(F.lit(seed + 2), "h", "_turn"))
    return taken.select(*(F.col("_row").getField(c).alias(c) for c in columns))
