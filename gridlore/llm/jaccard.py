"""Exact n-gram Jaccard join by vertical partitioning.

1. A count sketch of fixed size ranks n-grams from rare to frequent.  It only
   sets the order; the result is exact whatever it holds.
2. Each set sends its prefix, the rarest n - ceil(t n) + SHARED n-grams.  The
   first SHARED n-grams that two linked sets share lie in both prefixes, and in
   the smaller set among the rarest n - ceil(2 t n / (1 + t)) + SHARED, its head.
   An n-gram of at most LIGHT sets names all its pairs, and a pair that shares no
   other n-grams counts only with SHARED of them, so n-grams that two texts have
   by chance join nothing, however many texts there are.  Of any other n-gram,
   sorted by size, the sets with it in their heads are chained while neighbouring
   sizes allow a link, and every other set with it hangs on the one before it.
   The components are clusters, and every link lies within one.
3. The n-gram order is cut into fragments.  For each pair of blocks of sets and
   each fragment a task counts the partial overlaps of all sets at once as a
   matrix; the matrices are summed per pair of blocks, the threshold applied,
   and a spanning forest of the links kept.
4. First each set is held against the one before it with which it shares most
   of its prefix, at most one pair a set.  A cluster that these links join is
   settled.  In any other the sets of different components are compared, by
   blocks of bounded size: none within one component, and none whose sizes
   exclude a link.

Equal sets are one node, so copies never multiply.  Rows are made per pair only
in n-grams of LIGHT sets or fewer, less than LIGHT a set and n-gram.

Defined cases: a null or empty text has an empty set, no links and its own id as
component; fewer words than the n-gram size make one n-gram of the whole
sequence; rows that share an id are nodes by their text, each row returned; a
null id never names a component unless no other row does (then null), but such
rows are grouped like all others; empty
tables give no rows; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_ROWS, arrow_map, discard, grouped, lean, packed, stash, texts_only, unpacked
from .graph import components

SKETCH_BITS = 23
BITMAP_BITS = 24
FRAGMENT_BITS = 2
SHARED = 5
LIGHT = 16
BLOCK_SETS = 384
BLOCK_GRAMS = 1 << 20
_CHUNK = 1 << 16
_AT_ONCE = 1 << 16


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts sorted within each text, each text's bounds in them, and a hash of each set."""
    words = K.split_words(texts, K.NON_SPACE, lower=True)
    h, bounds, doc = K.hash_words(words), words.bounds, words.docs()
    at = K.grams_inside(bounds, size)
    grams, owner = [K.hash_grams(h, size)[at]], [doc[at]]
    count = np.diff(bounds)
    for k in range(1, size):
        short = bounds[:-1][count == k]
        if len(short):
            grams.append(K.hash_grams(h, k)[short])
            owner.append(doc[short])
    g, d = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    first = np.ones(len(g), dtype=bool)
    first[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[first], d[first]
    cuts = np.searchsorted(d, np.arange(len(count) + 1))
    total = np.concatenate(([np.uint64(0)], np.cumsum(K.mix(g ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    node = K.mix(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(np.uint64))
    return g, cuts, node


def _squeezed(counts: np.ndarray) -> bytes:
    small = counts.max() < 256
    return bytes([int(small)]) + zlib.compress(counts.astype(np.uint8 if small else "<u4").tobytes(), 1)


def _counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), dtype=np.uint8 if raw[0] else "<u4").astype(np.uint32)


def _sketch(texts: DataFrame, size: int) -> np.ndarray:
    """How common each n-gram is (a byte, eighths of a doubling) by the low SKETCH_BITS of its hash.

    Counts are summed in tasks; the driver gets a fixed number of bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for part in K.bites(batch, "text"):
                g, _, _ = _sets(part.column("text"), size)
                slot, n = np.unique((g & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32), return_counts=True)
                held[slot] += n.astype(np.uint32)
        for c, chunk in enumerate(held.reshape(-1, _CHUNK)):
            if chunk.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int64()), "counts": pa.array([_squeezed(chunk)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                held[c] = held.get(c, 0) + _counts(raw)
        for c, total in held.items():
            rank = np.minimum(np.round(8 * np.log2(1.0 + total)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int64()), "counts": pa.array([zlib.compress(rank.tobytes(), 1)], pa.binary())})

    schema = "chunk long, counts binary"
    parts = arrow_map(texts.select("text"), count, schema)
    rows = arrow_map(parts.repartition(16, "chunk"), add, schema).toArrow()
    total = np.zeros(((1 << SKETCH_BITS) // _CHUNK, _CHUNK), dtype=np.uint8)
    for c, raw in zip(rows.column("chunk").to_pylist(), rows.column("counts").to_pylist()):
        total[c] = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    return total.reshape(-1)


def _prefixes(texts: DataFrame, size: int, num: int, den: int, sketch) -> DataFrame:
    """token, node, n, head: the prefix of every set, once a task for equal sets; head: it is among those that a smaller set must share."""
    shared = SHARED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = sketch.value, set()
        for batch in batches:
            for part in K.bites(batch, "text"):
                g, cuts, node = _sets(part.column("text"), size)
                n = np.diff(cuts)
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((g, rank[(g & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)], doc))
                fresh = np.zeros(len(n), dtype=bool)
                for i, x in enumerate(node.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                place = np.arange(len(g)) - cuts[doc]
                take = (place < (n + (num * n) // -den + shared)[doc]) & fresh[doc]  # n - ceil(t n) + shared
                head = place < (n + (2 * num * n) // -(num + den) + shared)[doc]
                yield pa.RecordBatch.from_pydict({"token": g[order][take].view(np.int64), "node": node[doc][take].view(np.int64), "n": n[doc][take], "head": head[take]})

    return arrow_map(texts.select("text"), run, "token long, node long, n long, head boolean")


def _pairs(token: np.ndarray, node: np.ndarray, n: np.ndarray, head: np.ndarray, num: int, den: int, shared: int, light: int) -> pa.RecordBatch:
    """a, b, need and sure of whole n-grams, sorted by token, n and node: all pairs of one with few sets, the chain of any other (sure)."""
    own = np.ones(len(token), dtype=bool)
    own[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # equal sets from several tasks
    token, node, n, head = token[own], node[own], n[own], head[own]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    times = np.diff(np.append(start, len(token)))
    start, times = np.repeat(start, times), np.repeat(times, times)
    few = np.flatnonzero((times > 1) & (times <= light))
    i, j, sure = [], [], []
    for k in range(1, light):
        x, y = few[:-k], few[k:]
        same = token[x] == token[y]
        if not same.any():
            break
        i.append(x[same & head[x]])
        j.append(y[same & head[x]])
    sure.append(np.zeros(sum(map(len, i)), dtype=bool))
    last = np.maximum.accumulate(np.concatenate(([-1], np.where(head, np.arange(len(token)), -1)[:-1])))
    many = np.flatnonzero((times > light) & (last >= start))
    i.append(last[many])
    j.append(many)
    sure.append(np.ones(len(many), dtype=bool))
    i, j, sure = np.concatenate(i), np.concatenate(j), np.concatenate(sure)
    fits = den * n[i] >= num * n[j]
    i, j, sure = i[fits], j[fits], sure[fits]
    need = np.minimum(shared, (2 * num * n[i]) // -(num + den) * -1)
    return pa.RecordBatch.from_pydict({"a": node[i], "b": node[j], "need": need, "sure": sure})


def _voted(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, times: pairs of sets, the smaller first, that share times n-grams of their prefixes; every link is within a component of them."""
    shared, light = SHARED, LIGHT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wait = [], 0, _AT_ONCE
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "node", "n", "head")])
            rows += batch.num_rows
            if rows < wait:
                continue
            table = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(table[0], table[0][-1]))  # the last n-gram may go on
            if cut:
                yield _pairs(*(c[:cut] for c in table), num, den, shared, light)
            held, rows = [[c[cut:] for c in table]], rows - cut
            wait = max(_AT_ONCE, 2 * rows)
        if rows:
            yield _pairs(*(np.concatenate(c) for c in zip(*held)), num, den, shared, light)

    met = arrow_map(prefixes.repartition("token").sortWithinPartitions("token", "n", "node"), run, "a long, b long, need long, sure boolean")
    counted = met.groupBy("a", "b").agg(F.count("*").alias("times"), F.max("need").alias("need"), F.max("sure").alias("sure"))
    return counted.filter("sure OR times >= need").select("a", "b", "times")


def _segments(texts: DataFrame, size: int, bitmap) -> DataFrame:
    """node, fragment and grams, for sets whose node the bitmap holds, once a task.

    Fragments of the n-gram order are ranges of the hash, so slices of the sorted set.
    """
    parts = 1 << FRAGMENT_BITS
    edges = np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - FRAGMENT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bitmap.value, set()
        for batch in batches:
            for part in K.bites(batch, "text"):
                g, cuts, node = _sets(part.column("text"), size)
                slot = node >> np.uint64(64 - BITMAP_BITS)
                there = ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)) == 1
                rows = []
                for i in np.flatnonzero(there & (np.diff(cuts) > 0)):
                    if (x := int(node[i])) not in seen:
                        seen.add(x)
                        rows.append(i)
                pieces = []
                for i in rows:
                    own = g[cuts[i] : cuts[i + 1]]
                    pieces += [x.tobytes() for x in np.split(own, np.searchsorted(own, edges))]
                yield pa.RecordBatch.from_pydict({"node": np.repeat(node[rows].view(np.int64), parts), "fragment": np.tile(np.arange(parts, dtype=np.int64), len(rows)), "grams": pa.array(pieces, pa.binary())})

    return arrow_map(texts.select("text"), run, "node long, fragment long, grams binary")


def _nodes(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.bites(batch, "text"):
                _, cuts, node = _sets(part.column("text"), size)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "node": node.view(np.int64), "n": np.diff(cuts)})

    return arrow_map(texts, run, "doc_id long, text_hash long, node long, n long")


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A fixed number of bits that holds every node; at most 2 ** (BITMAP_BITS - 6) rows come to the driver."""
    rows = nodes.select(F.shiftrightunsigned("node", 70 - BITMAP_BITS).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - BITMAP_BITS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    bits[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return bits


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first and of the second block, in the order of their nodes."""
    side, node = group.column("side").to_numpy(), group.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    return order[side[order] == 0], order[side[order] == 1]


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks and fragment, how many n-grams of the fragment each two sets share."""
    for key, group in grouped(batches, "cluster", "bi", "bj", "fragment"):
        if len(own := np.unique(group.column("node").to_numpy(), return_index=True)[1]) < group.num_rows:
            group = group.take(pa.array(own))  # equal sets from several tasks
        a, b = _sides(group)
        if key[1] == key[2]:
            b = a
        raw = group.column("grams").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        where = K.flat_offsets(raw) // 8
        every = np.frombuffer(b"".join(raw.to_pylist()), dtype="<u8")
        where = where - where[0]
        owner = np.repeat(np.arange(len(raw)), np.diff(where))
        _, code, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times[code] > 1
        owner, code = owner[shared], code[shared]
        dense = np.cumsum(times > 1) - 1
        code = dense[code]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        count = np.zeros((len(a), len(b)), dtype=np.float32)
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
            lo, hi = np.searchsorted(code, [start, start + 2048])
            has = np.zeros((len(raw), 2048), dtype=np.float32)
            has[owner[lo:hi], code[lo:hi] - start] = 1
            count += has[a] @ has[b].T
        node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
        pack = lambda x, t: [np.ascontiguousarray(x).astype(t).tobytes()]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([key[0]], pa.int64()), "bi": pa.array([key[1]], pa.int64()), "bj": pa.array([key[2]], pa.int64()), "a": pack(node[a], "<i8"), "b": pack(node[b], "<i8"), "na": pack(n[a], "<i8"), "nb": pack(n[b], "<i8"), "partial": pack(count, "<i4")})


_PARTIAL = "cluster long, bi long, bj long, a binary, b binary, na binary, nb binary, partial binary"


def _forest(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum the partial overlaps of each pair of blocks; a spanning forest of its links."""
        for _, group in grouped(batches, "cluster", "bi", "bj"):
            get = lambda c, t: np.frombuffer(group.column(c)[0].as_py(), dtype=t)
            a, b, na, nb = get("a", "<i8"), get("b", "<i8"), get("na", "<i8"), get("nb", "<i8")
            total = np.zeros(len(a) * len(b), dtype=np.int64)
            for x in group.column("partial"):
                total += np.frombuffer(x.as_py(), dtype="<i4")
            total = total.reshape(len(a), len(b))
            linked = den * total >= num * (na[:, None] + nb[None, :] - total)
            linked &= a[:, None] != b[None, :]
            i, j = np.nonzero(linked)
            nodes, flat = np.unique(np.concatenate((a[i], b[j])), return_inverse=True)
            u, v = flat[: len(i)], flat[len(i) :]
            label = np.arange(len(nodes))
            while True:
                new = label.copy()
                np.minimum.at(new, u, label[v])
                np.minimum.at(new, v, label[u])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            off = label != np.arange(len(nodes))
            yield pa.RecordBatch.from_pydict({"a": nodes[label[off]], "b": nodes[off]})

    return run


def _forest_of(texts: DataFrame, nodes: DataFrame, places: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """a, b: a spanning forest of the links in each pair of blocks that places (node, n, cluster, bi, bj, side) lists; nodes: those in it."""
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(nodes))
    segments = _segments(texts, size, bits)
    if places.count() <= BROADCAST_ROWS:
        segments = segments.join(F.broadcast(places), "node")
    else:
        segments = segments.dropDuplicates(["node", "fragment"]).join(places, "node")
    keys = ("cluster", "bi", "bj")
    partial = arrow_map(segments.repartition(*keys, "fragment").sortWithinPartitions(*keys, "fragment"), _overlaps, _PARTIAL)
    return arrow_map(partial.repartition(*keys).sortWithinPartitions(*keys), _forest(num, den), "a long, b long")


def _blocks():
    """How many blocks the rows of a group take."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("long")


def _stars(voted: DataFrame, sized: DataFrame) -> DataFrame:
    """The places of every set and of the one before it that shares most of its prefix; many sets with one before them are several blocks."""
    best = voted.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).withColumnRenamed("b", "node").join(sized.select("node", "n"), "node")
    best = best.join(best.groupBy("a").agg(_blocks().alias("blocks")), "a")
    arms = best.select("node", "n", F.col("a").alias("cluster"), F.lit(0).cast("long").alias("bi"), (1 + F.pmod(F.xxhash64("node"), "blocks")).alias("bj"), F.lit(1).cast("long").alias("side"))
    heads = arms.select(F.col("cluster").alias("node"), "cluster", "bi", "bj").distinct().join(sized.select("node", "n"), "node")
    return arms.unionByName(heads.withColumn("side", F.lit(0).cast("long")))


def _across(state: DataFrame, num: int, den: int) -> DataFrame:
    """The places of all sets whose cluster is of several components (state: node, n, cluster, part), so that each two of different
    components meet if their sizes allow a link.

    A cluster of one block is one place.  Others are cut into bands of size, a
    linked set being in the same band or the next, and within these into blocks:
    those of one large component, or of all small ones.
    """
    clusters = state.groupBy("cluster").agg(_blocks().alias("needed"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    rest = state.join(clusters.select("cluster", "needed"), "cluster")
    zero = F.lit(0).cast("long")
    whole = rest.filter("needed = 1").select("node", "n", "cluster", zero.alias("bi"), zero.alias("bj"), zero.alias("side"))
    band = F.floor(F.log("n") / F.lit(1.000001 * math.log(den / num))).cast("long")  # a little wide, so that rounding cannot part linked sets by two
    wide = rest.filter("needed > 1").withColumn("band", band)
    large = wide.groupBy("cluster", "part").agg(_blocks().alias("b"), F.count("*").alias("c")).filter((F.col("b") > 1) | (4 * F.col("c") >= BLOCK_SETS))
    wide = wide.join(large.select("cluster", "part", F.col("part").alias("own")), ["cluster", "part"], "left").withColumn("unit", F.xxhash64("band", F.col("own").isNull(), "own"))
    wide = wide.join(wide.groupBy("cluster", "unit").agg(_blocks().alias("blocks")), ["cluster", "unit"]).withColumn("block", F.xxhash64("unit", F.pmod(F.xxhash64("node"), "blocks")))
    wide = stash(wide.select("node", "n", "cluster", "band", "own", "block"), "blocks")
    blocks = wide.select("cluster", "band", "own", "block").distinct()
    x = blocks.select("cluster", F.col("own").alias("x_own"), F.col("block").alias("bi"), F.col("band").alias("x_band"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    met = x.join(blocks, ["cluster", "band"]).withColumnRenamed("block", "bj").filter("(band > x_band OR bi <= bj) AND NOT coalesce(x_own = own, false)")
    sides = met.select("cluster", "bi", "bj", F.explode(F.expr("if(bi = bj, array(struct(bi AS block, 0L AS side)), array(struct(bi AS block, 0L AS side), struct(bj AS block, 1L AS side)))")).alias("s")).select("cluster", "bi", "bj", "s.block", "s.side")
    return whole.unionByName(wide.join(sides, ["cluster", "block"]).select("node", "n", "cluster", "bi", "bj", "side"))


def _linked(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """links(), and group, which all texts of a component have in common (null for an empty set)."""
    spark = docs.sparkSession
    texts = texts_only(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    sketch = spark.sparkContext.broadcast(_sketch(texts, size))
    voted = stash(_voted(_prefixes(texts, size, num, den, sketch), num, den), "voted")
    cluster = components(voted.select("a", "b"), "clusters").withColumnRenamed("component", "cluster")
    rows = stash(_nodes(texts, size), "nodes")
    sized = stash(rows.filter("n > 0").select("node", "n").distinct().join(cluster, "node"), "sized")
    stars = stash(_stars(voted, sized), "stars")
    forest = stash(_forest_of(texts, sized, stars, size, num, den), "forest")
    discard(voted, stars)
    part = components(forest, "parts").withColumnRenamed("component", "part")
    state = stash(sized.join(part, "node", "left").withColumn("part", F.coalesce("part", "node")), "state")
    across = stash(_across(state, num, den), "across")
    more = _forest_of(texts, across.select("node").distinct(), across, size, num, den)
    joined = stash(components(forest.union(more), "links"), "joined")
    discard(forest, sized, state, across)
    group = F.coalesce("component", "node")
    named = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(joined, "node", "left").select("node", "least", group.alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", F.col("component").alias("group"), "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named, "node", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("group"))


def links(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles and component_id of every row; two texts link when den * intersection >= num * union."""
    return _linked(docs, size, num, den).drop("group")


def one_each(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs with one row of each component: the least by id (none last) and then by the text's hash; rows with an empty set are linked with nothing and stay."""
    found = stash(_linked(docs, size, num, den).filter("n_shingles > 0").select("doc_id", "text_hash", "group"), "linked")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r")
    crowds = found.groupBy("group").agg(least, F.count("*").alias("rows")).filter("rows > 1").select("group", F.col("r.doc_id").alias("rep_id"), F.col("r.text_hash").alias("rep_hash"))
    members = found.join(crowds, "group").withColumn("is_rep", F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
    counted = stash(members.groupBy(F.col("doc_id").alias("_member"), F.col("text_hash").alias("_member_hash"), "is_rep").agg(F.count("*").alias("rows")), "members")
    go = lean(counted.filter("NOT is_rep").select("_member", "_member_hash"), "duplicates")
    again = lean(counted.filter("is_rep AND rows > 1").select("_member", "_member_hash"), "repeated")  # representatives that several rows are
    same = F.col("_id").eqNullSafe(F.col("_member")) & (F.col("_hash") == F.col("_member_hash"))
    stay = packed(docs).join(go, same, "left_anti")
    once = stay.join(again, same, "left_semi").dropDuplicates(["_id", "_hash"])
    return unpacked(stay.join(again, same, "left_anti").union(once), docs)
