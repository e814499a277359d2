"""Forests and boosted trees with exact splits: every value of every sample may be a cut.

Trees are grown level by level, all open nodes of a level at once, on the ranks of
the samples' values.  A forest's trees are dealt over tasks, each of which has all
samples; boosted trees follow one another in one task.  Whoever fits more than
FIT_BYTES allows takes Spark's own estimators, which only cut between 128 bins.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions import vectors as V

#: what the samples, or the trees at their largest, may take in memory
FIT_BYTES = 512 << 20
#: values of all samples that boosted trees, which grow in one task for each class, are fitted on here
BOOST_VALUES = 1 << 23
#: numbers that a step of the search for cuts holds at once
STEP = 1 << 17
#: bytes of a task that predicts, from which on a table is left in the tasks that read it
TASK_BYTES = 128 << 20
TREE = "tree int, feature binary, cut binary, left binary, value binary"


@dataclass
class Tree:
    """Nodes in order of level: the right child follows the left one; a leaf has feature -1 and its row of value in left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The row of value for each row of x."""
        out = np.full(len(x), self.left[0], np.int32)
        if self.feature[0] < 0:
            return out
        values, rows = np.ascontiguousarray(x).reshape(-1), np.arange(len(x))
        begin, node = rows * x.shape[1], np.zeros(len(x), np.int64)
        while len(rows):
            node = self.left.take(node) + (values.take(begin + self.feature.take(node)) > self.cut.take(node))
            goes = self.feature.take(node) >= 0
            if not goes.all():
                out[rows[~goes]] = self.left.take(node[~goes])
                rows, begin, node = rows[goes], begin[goes], node[goes]
        return out


class Ranked:
    """The samples: the dense rank of each value in its band, and the bands' values in order."""

    def __init__(self, x: np.ndarray):
        self.values, ranks = [], np.empty((x.shape[1], len(x)), np.int64)
        for b in range(x.shape[1]):
            u, ranks[b] = np.unique(x[:, b], return_inverse=True)
            self.values.append(u)
        self.ranks = ranks
        self.bits = max(1, int(len(x) - 1).bit_length())


def _best_cuts(data: Ranked, rows: np.ndarray, seg: np.ndarray, starts: np.ndarray, bands: np.ndarray, target: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment (a node's rows, which lie together) the best cut's score (-inf: none), band and rank left of it.

    bands: those to try, a row a segment.  target: classes (integers), or numbers
    of any mean.  The score is greatest where Gini impurity or variance is least: of
    classes the sum of squared sums over weight on both sides, of numbers, less their
    segment's mean, the squared sum of one side over the weights of both.
    """
    n, many = len(rows), len(starts)
    ends = np.append(starts[1:], n)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    classes = np.issubdtype(target.dtype, np.integer)
    place = np.arange(n)
    unfit = last | (place - starts[seg] + 1 < least) | (ends[seg] - 1 - place < least)
    score, band, rank = np.full(many, -np.inf), np.zeros(many, np.int64), np.zeros(many, np.int64)
    mask = (1 << data.bits) - 1
    w0, t0 = weight[rows], target[rows]

    def shares(v: np.ndarray, starts: np.ndarray, ends: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum before each row's segment and within it: the same in whatever order a segment's rows are."""
        c = np.cumsum(v)
        before = np.where(starts > 0, c[starts - 1], 0.0)
        return before[seg], (c[ends - 1] - before)[seg]

    before, total = shares(w0, starts, ends, seg)
    if classes:
        # a segment's rows of one class are a group; by_group: their weights' sums before the group and in it, in order of group
        group = seg * (int(t0.max()) + 1) + t0
        order = np.argsort(group, kind="stable")
        in_order = group[order]
        new = np.append(True, in_order[1:] != in_order[:-1])
        begin = np.flatnonzero(new)
        group_before, own = shares(w0[order], begin, np.append(begin[1:], n), np.cumsum(new) - 1)
        moved = np.empty(n)
        moved[order] = 2 * own
        moved *= w0
        grouped = group << data.bits
        squares = np.add.reduceat(moved, starts)[seg] / 2  # of the classes' sums in the segment
    else:
        moved = w0 * (t0 - (np.add.reduceat(w0 * t0, starts) / np.add.reduceat(w0, starts))[seg])
    moved_before, _ = shares(moved, starts, ends, seg)
    base, same = (seg << data.bits), (bands == bands[0]).all()
    step = max(1, STEP // n)
    for s in range(0, bands.shape[1], step):
        tried = bands[:, s : s + step]
        key = data.ranks[tried[0]].take(rows, axis=1) if same else data.ranks[tried[seg].T, rows]
        key |= base
        key <<= data.bits
        key |= place
        key.sort(axis=1)
        picked = key & mask
        key >>= data.bits
        w = w0.take(picked)
        here = np.cumsum(w, axis=1)
        here -= before
        a = moved.take(picked)
        np.cumsum(a, axis=1, out=a)
        a -= moved_before
        if classes:
            # with L the classes' sums left of the cut and T those of the segment: a is 2 sum(L T), got sum(L L)
            by_group = grouped.take(picked)
            by_group |= place
            by_group.sort(axis=1)
            by_group &= mask
            by_group += np.arange(0, picked.size, n)[:, None]
            w = w.take(by_group)
            got = np.cumsum(w, axis=1)
            got -= group_before
            got *= 2
            got -= w
            got *= w
            gained = np.empty(got.size)
            gained[by_group] = got
            np.cumsum(gained.reshape(got.shape), axis=1, out=got)
            got -= got[:, starts - 1][:, seg] * (starts > 0)[seg]
            right = squares - a
            right += got
            got /= here
            here -= total
            np.negative(here, out=here)
            here[:, last] = 1.0
            right /= here
            got += right
        else:
            # the numbers' sums on both sides are opposite: what they give is their square over both weights
            w = total - here
            w *= here
            w[:, last] = 1.0
            a *= a
            a /= w
            got = a
        none = np.empty(got.shape, bool)
        np.equal(key[:, :-1], key[:, 1:], out=none[:, :-1])
        none[:, -1] = True
        none |= unfit
        np.copyto(got, -np.inf, where=none)
        most = np.maximum.reduceat(got, starts, axis=1)
        slot = most.argmax(axis=0)
        top = most[slot, np.arange(many)]
        better = top > score
        hit = (got[slot[seg], place] == top[seg]) & better[seg]
        where, first = np.unique(seg[hit], return_index=True)
        at = place[hit][first]
        score[where], band[where] = top[where], tried[where, slot[where]]
        rank[where] = key[slot[where], at] & mask
    return score, band, rank


def grow(data: Ranked, target: np.ndarray, weight: np.ndarray, classes: int, depth: int | None, bands: int, least: int, rng: np.random.Generator) -> Tree:
    """One tree over the samples of a weight above 0; classes 0: of numbers.  A node without a cut among its bands tries all of them."""
    every = len(data.values)
    rows = np.flatnonzero(weight > 0)
    node = np.zeros(len(rows), np.int64)
    feature, cut, left, value = [np.full(1, -1, np.int16)], [np.zeros(1)], [np.zeros(1, np.int32)], []
    first, leaves, level = 0, 0, 0
    weight = weight.astype(np.float64)
    while len(rows):
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        new = np.append(True, node[1:] != node[:-1])
        starts, seg = np.flatnonzero(new), np.cumsum(new) - 1
        sizes = np.diff(np.append(starts, len(rows)))
        t = target[rows]
        low, high = np.minimum.reduceat(t, starts), np.maximum.reduceat(t, starts)
        opened = (low != high) & (sizes >= 2 * least)
        if depth is not None and level >= depth:
            opened[:] = False
        band, rank = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)

        def search(which: np.ndarray, tried: int) -> None:
            """Cuts of the segments that are marked, in place; those without one are closed."""
            inside = which[seg]
            if not inside.any():
                return
            at = np.flatnonzero(which)
            part = rows[inside]
            begin = np.append(0, np.cumsum(sizes[at])[:-1])
            draw = np.broadcast_to(np.arange(every), (len(at), every)) if tried >= every else np.argpartition(rng.random((len(at), every), dtype=np.float32), tried - 1, axis=1)[:, :tried]
            score, b, r = _best_cuts(data, part, np.repeat(np.arange(len(at)), sizes[at]), begin, draw, target, weight, least)
            band[at], rank[at] = b, r
            opened[at] = score > -np.inf

        wanted = opened.copy()
        search(wanted, bands)
        if bands < every:
            search(wanted & ~opened, every)
        # a level's nodes are those of its segments, in order
        closed = ~opened
        w = weight[rows]
        if classes:
            sums = np.zeros((len(starts), classes))
            np.add.at(sums, (seg, t), w)
            means = sums / sums.sum(axis=1, keepdims=True)
        else:
            means = np.where(low == high, low, np.add.reduceat(w * t, starts) / np.add.reduceat(w, starts))[:, None]
        value.append(means[closed])
        f, c, l = np.where(opened, band, -1).astype(np.int16), np.zeros(len(starts)), np.zeros(len(starts), np.int32)
        l[closed] = leaves + np.arange(closed.sum())
        leaves += int(closed.sum())
        first += len(starts)
        l[opened] = first + 2 * np.arange(opened.sum())
        goes = opened[seg]
        rows, seg = rows[goes], seg[goes]
        of_row = data.ranks[band[seg], rows]
        right = of_row > rank[seg]
        # the least rank right of the cut, for a cut half way
        above = np.full(len(starts), np.iinfo(np.int64).max)
        np.minimum.at(above, seg[right], of_row[right])
        for i in np.flatnonzero(opened):
            u = data.values[band[i]]
            a, b = u[rank[i]], u[above[i]]
            c[i] = a + (b - a) / 2 if a + (b - a) / 2 < b else a
        feature[level:], cut[level:], left[level:] = [f], [c], [l]
        node = l[seg].astype(np.int64) + right
        level += 1
    held = np.concatenate(value)
    feature, left = np.concatenate(feature), np.concatenate(left)
    if classes:  # most leaves are of one class
        held, back = np.unique(held, axis=0, return_inverse=True)
        leaf = feature < 0
        left[leaf] = back.reshape(-1)[left[leaf]]
    return Tree(feature, np.concatenate(cut), left, held)


def _packed(i: int, t: Tree) -> tuple:
    return i, t.feature.astype(np.int16).tobytes(), t.cut.astype(np.float64).tobytes(), t.left.astype(np.int32).tobytes(), t.value.astype(np.float64).tobytes()


def _matrix(column: pa.Array, bands: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False)
    if len(x) != bands * len(column) or (np.asarray(column.value_lengths()) != bands).any():
        raise ValueError("vectors differ in their number of bands")
    return x.astype(np.float64, copy=False).reshape(len(column), bands)


def _samples(df: DataFrame, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels in an order of their own, whatever the table's is."""
    held = df.select(V.as_double("embedding").alias("e"), F.col(label).cast("double").alias("y")).toArrow().combine_chunks()
    if not len(held):
        raise ValueError("no training samples")
    e = held.column("e").combine_chunks()
    x, y = _matrix(e, len(e[0])), held.column("y").to_numpy()
    order = np.lexsort((y, *x.T[::-1]))
    return x[order], y[order]


def _spread(df: DataFrame) -> DataFrame:
    """The table dealt anew where few tasks might read it (a row group is one's): to predict costs more than to move a row.  A large one, or one whose size Spark does not know, stays."""
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(tasks) if held < tasks * TASK_BYTES else df


class TreesModel:
    """Trees and how their values are joined: the mean of a forest, the weighted sum and a start of boosted trees."""

    def __init__(self, spark, rows: list[tuple], about: dict[str, Any]):
        self.rows, self.about = rows, about
        self._shared = spark.sparkContext.broadcast(pickle.dumps((rows, about), pickle.HIGHEST_PROTOCOL))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, TREE)

    def transform(self, df: DataFrame) -> DataFrame:
        """df, without features, with prediction and, of classes, probability."""
        df, shared, classes = df.drop("features"), self._shared, self.about["classes"]
        schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())])
        if classes:
            schema.add("probability", T.ArrayType(T.DoubleType()))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = about = None
            for batch in batches:
                if trees is None:
                    trees, about = read(pickle.loads(shared.value))
                x = _matrix(batch.column(batch.schema.get_field_index("embedding")), about["bands"])
                p = joined(trees, about, x)
                columns = [*batch.columns, pa.array(p.argmax(axis=1).astype(np.float64) if classes else p[:, 0])]
                names = [*batch.schema.names, "prediction"]
                if classes:
                    columns.append(pa.ListArray.from_arrays(np.arange(0, p.size + 1, classes, dtype=np.int32), pa.array(p.reshape(-1))))
                    names.append("probability")
                yield pa.RecordBatch.from_arrays(columns, names)

        out = _spread(df).mapInArrow(part, schema)
        return out.withColumn("probability", array_to_vector("probability")) if classes else out


def read(held: tuple[list[tuple], dict[str, Any]]) -> tuple[list[Tree], dict[str, Any]]:
    rows, about = held
    width = about["width"]
    return [Tree(np.frombuffer(f, np.int16), np.frombuffer(c), np.frombuffer(n, np.int32), np.frombuffer(v).reshape(-1, width)) for _, f, c, n, v in rows], about


def joined(trees: list[Tree], about: dict[str, Any], x: np.ndarray) -> np.ndarray:
    """Probabilities of the classes, or numbers in one column."""
    classes, rate = about["classes"], about.get("rate")
    if rate is None:
        total = np.zeros((len(x), about["width"]))
        for t in trees:
            total += t.value[t.apply(x)]
        return total / len(trees)
    raw = np.zeros((len(x), about["targets"]))
    for i, t in enumerate(trees):
        raw[:, i // about["rounds"]] += _step(i % about["rounds"], rate) * t.value[t.apply(x), 0]
    if not classes:
        return raw
    if classes == 2:  # the score is half the log odds
        p = 1 / (1 + np.exp(-2 * np.clip(raw, -300, 300)))
        return np.hstack([1 - p, p])
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _step(i: int, rate: float) -> float:
    """As in Spark's boosted trees, the first tree counts in full."""
    return rate if i else 1.0


def _number_of_bands(kind: str | float, bands: int) -> int:
    if kind == "all":
        return bands
    n = math.sqrt(bands) if kind == "sqrt" else math.log2(bands) if kind == "log2" else float(kind) * bands
    return max(1, min(bands, int(n)))


@dataclass
class Forest:
    """A random forest: each tree of a bootstrap sample, each node of a draw of bands.  spark_estimator: for more samples than fit."""

    classes: int
    n_estimators: int
    seed: int
    depth: int | None
    bands: str | float
    least: int
    spark_estimator: Any

    def fit(self, df: DataFrame):
        n, size = df.agg(F.count("*"), F.max(F.size("embedding"))).first()
        if n * max(8 * (size or 0), 36 * self.n_estimators) > FIT_BYTES:
            return self.spark_estimator.fit(df)
        spark = df.sparkSession
        x, y = _samples(df, "code" if self.classes else "label")
        classes, seed, depth, least, wanted = self.classes, self.seed, self.depth, self.least, _number_of_bands(self.bands, x.shape[1])

        def one(i: int, data: Ranked, x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
            rng = np.random.default_rng((seed, i))
            weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y))
            yield _packed(i, grow(data, y, weight, classes, depth, wanted, least, rng))

        rows = _grown(spark, one, self.n_estimators, x, y.astype(np.int64) if classes else y)
        return TreesModel(spark, rows, {"classes": classes, "width": classes or 1, "bands": x.shape[1]})


@dataclass
class Boosted:
    """Boosted trees, by Spark's losses and steps; more than two classes one against the others, each in its own task."""

    classes: int
    n_estimators: int
    seed: int
    depth: int
    rate: float
    spark_estimator: Any

    def fit(self, df: DataFrame):
        n, size = df.agg(F.count("*"), F.max(F.size("embedding"))).first()
        if n * (size or 0) > BOOST_VALUES:
            return self.spark_estimator.fit(df)
        spark = df.sparkSession
        x, y = _samples(df, "code" if self.classes else "label")
        classes, rounds, seed, depth, rate = self.classes, self.n_estimators, self.seed, self.depth, self.rate

        def one(k: int, data: Ranked, x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
            rng, weight, raw = np.random.default_rng((seed, k)), np.ones(len(y)), np.zeros(len(y))
            aim = np.where(y == (k if classes > 2 else 1), 1.0, -1.0) if classes else y
            for i in range(rounds):
                rest = aim if i == 0 else 4 * aim / (1 + np.exp(2 * np.clip(aim * raw, -300, 300))) if classes else 2 * (aim - raw)
                tree = grow(data, rest, weight, 0, depth, x.shape[1], 1, rng)
                raw += _step(i, rate) * tree.value[tree.apply(x), 0]
                yield _packed(k * rounds + i, tree)

        targets = classes if classes > 2 else 1
        rows = _grown(spark, one, targets, x, y)
        return TreesModel(spark, rows, {"classes": classes, "width": 1, "bands": x.shape[1], "rate": rate, "rounds": rounds, "targets": targets})


def _grown(spark, one, tasks: int, x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """The rows of one(i, ranked samples, x, y) for each i below tasks, in order of tree."""
    shared = spark.sparkContext.broadcast((x, y))
    schema = pa.schema([("tree", pa.int32()), *((c, pa.binary()) for c in ("feature", "cut", "left", "value"))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = None
        for batch in batches:
            for i in batch.column("id").to_pylist():
                x, y = shared.value
                data = data or Ranked(x)
                for row in one(i, data, x, y):
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    parts = max(1, min(tasks, 4 * spark.sparkContext.defaultParallelism))
    grown = spark.range(0, tasks, 1, parts).mapInArrow(part, TREE).toArrow().to_pylist()
    shared.unpersist()
    return sorted(tuple(r[c] for c in schema.names) for r in grown)
