"""Hidden Markov language model: Baum-Welch across partitions, exact scaled forward scoring.

Tokens are the words of a text and one end.  Every training word is counted
over the whole corpus.  The ``own`` most frequent words are symbols of their
own (a parameter; the number of states' sums grows with it); any other word is a symbol for its ending (``TAILS`` of them) and then,
within it, itself with probability (c + 1) / (N + V + 1) of the ending's words.
Latent states emit symbols; each Baum-Welch pass reads all training documents,
adds expected counts up in tasks, and the driver gets a fixed number of sums.

Scoring runs the scaled forward recursion over whole texts.  Counts of the
``KNOWN`` most frequent words are broadcast (a fixed number); those of all other
words are joined by the word's 64-bit hash.

Defined cases: a null or empty text is the end alone; a null id is a training
document; repeated rows count and are scored each; without training documents
all counts are 0 and states are uniform; empty tables give no rows; long texts
are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_map, discard, row_ids, stash

OWN, TAILS, KNOWN = 8192, 2048, 1 << 18
_FLUSH = 1_000_000
#: text laid out at a time: a step of the recursion costs the same for few documents as for many
_LATTICE_BYTES = 4 << 20
#: the same for symbols, which take two bytes each
_SYMBOL_BYTES = 3 << 19


def _tail(words: K.Words, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The ending of each word: a number below TAILS made of its last three bytes."""
    ends = words.ends[rows]
    size = ends - words.starts[rows]
    h = np.zeros(len(ends), dtype=np.uint64)
    for j in (1, 2, 3):
        byte = np.where(size >= j, words.data[np.maximum(ends - j, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        h = h * np.uint64(257) + byte
    return (K.mix(h) % np.uint64(TAILS)).astype(np.int64)


def _split(texts: pa.Array) -> tuple[K.Words, np.ndarray]:
    words = K.split_words(texts, K.NON_SPACE, lower=True)
    return words, K.hash_words(words).view(np.int64)


def _prepared(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))


def count_words(train: DataFrame) -> DataFrame:
    """h, tail and c of every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, tail, c = (np.concatenate(x) for x in zip(*held))
            u, first, code = np.unique(h, return_index=True, return_inverse=True)
            return u, tail[first], np.bincount(code, weights=c).astype(np.int64)

        def out(h, tail, c):
            return pa.RecordBatch.from_pydict({"h": h, "tail": tail.astype(np.int32), "c": c})

        for batch in batches:
            for part in K.bites(batch, "text"):
                words, h = _split(part.column("text"))
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, _tail(words)[first], c))
                if len(held) >= 8:
                    held = [merged()]
                    if len(held[0][0]) > _FLUSH:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    return arrow_map(train.select("text"), run, "h long, tail int, c long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    known: np.ndarray  # hashes, ascending, of at most KNOWN words
    counts: np.ndarray
    symbol: np.ndarray  # of each known word: below OWN, or OWN + its ending
    end_count: int
    total: int  # N
    distinct: int  # V
    weight: np.ndarray  # training tokens of each symbol
    inside: np.ndarray  # log10 of N + V + 1 of each ending, 0 for words of their own
    own: int  # words that are symbols of their own

    @property
    def end(self) -> int:
        return self.own + TAILS

    def __post_init__(self):
        # where the known hashes of each of 2 ** 20 leading parts begin, so that a search is a step or two
        self._from = np.searchsorted(self.known >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the known, or -1."""
        lead = (h >> np.uint64(44)).astype(np.int64)
        at, end = self._from[lead], self._from[lead + 1]
        out = np.full(len(h), -1, dtype=np.int64)
        open_ = np.flatnonzero(at < end)
        at, end, wanted = at[open_], end[open_], h[open_]
        while len(open_):
            hit = self.known[at] == wanted
            out[open_[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            open_, at, end, wanted = open_[on], at[on] + 1, end[on], wanted[on]
        return out

    def symbols(self, words: K.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word and its count, -1 where it is not among the known."""
        at = self.find(h.view(np.uint64))
        there = at >= 0
        symbol, count = np.empty(len(h), dtype=np.int64), np.full(len(h), -1, dtype=np.int64)
        symbol[there], count[there] = self.symbol[at[there]], self.counts[at[there]]
        rest = np.flatnonzero(~there)
        symbol[rest] = self.own + _tail(words, rest)
        return symbol, count


def vocabulary(counts: DataFrame, n_train: int, own: int = OWN) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # the counts from which on no more than KNOWN words are left, by a histogram of a few thousand rows at most
    level = F.floor(64 * F.log2(F.col("c"))).cast("int")
    # all words of the levels that fit, and of the first that does not a share, by their hash: about KNOWN words whatever their counts
    cut, many, share = -1, 0, 0.0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if many + r["count"] > KNOWN:
            cut, share = r["level"], (KNOWN - many) / r["count"]
            break
        many += r["count"]
    lot = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20))
    top = counts.filter((level > cut) | ((level == cut) & lot)).toArrow()
    h, tail, c = (top.column(x).to_numpy() for x in ("h", "tail", "c"))
    order = np.lexsort((h, -c))
    h, tail, c = h[order], tail[order], c[order]
    symbol = np.where(np.arange(len(h)) < own, np.arange(len(h)), own + tail.astype(np.int64))
    weight, kinds = np.zeros(own + TAILS + 1, dtype=np.int64), np.zeros(own + TAILS + 1, dtype=np.int64)
    for r in counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # at most TAILS
        weight[own + r["tail"]], kinds[own + r["tail"]] = r["n"], r["v"]
    first = min(own, len(h))
    np.subtract.at(weight, own + tail[:first], c[:first])
    np.subtract.at(kinds, own + tail[:first], 1)
    weight[:first], weight[-1] = c[:first], n_train
    inside = np.zeros(own + TAILS + 1)
    inside[own:-1] = np.log10(weight[own:-1] + kinds[own:-1] + 1)
    h = h.view(np.uint64)
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], symbol[order], n_train, int(total["n"] or 0) + n_train, int(total["v"]) + (n_train > 0), weight, inside, own)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (states, symbols)


def first_guess(vocab: Vocabulary, states: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    prior = (vocab.weight + 1) / (vocab.weight + 1).sum()
    emit = prior * rng.uniform(0.2, 1.8, (states, len(prior)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


class Lattice:
    """Symbol sequences of a batch laid out step by step, the longest first, so that step t is one slice."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        size = np.diff(bounds)
        self.order = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), dtype=np.int64)
        rank[self.order] = np.arange(len(size))
        self.steps = int(size.max()) if len(size) else 0
        live = len(size) - np.searchsorted(np.sort(size), np.arange(self.steps), side="right")
        self.at = np.concatenate(([0], np.cumsum(live)))
        doc = np.repeat(np.arange(len(size)), size)
        t = np.arange(len(symbols)) - bounds[doc]
        self.place = self.at[t] + rank[doc]
        self.symbols = np.empty(len(symbols), dtype=np.int64)
        self.symbols[self.place] = symbols
        self.live, self.doc_rank = live, rank

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled alphas, scales and emissions of all places."""
        seen = np.ascontiguousarray(model.emit.T)[self.symbols]
        alpha, scale = np.empty_like(seen), np.empty(len(seen))
        for t in range(self.steps):
            a, b = self.at[t], self.at[t + 1]
            now = seen[a:b] * model.start if t == 0 else (last[: b - a] @ model.move) * seen[a:b]
            s = now.sum(axis=1)
            now /= s[:, None]
            alpha[a:b], scale[a:b], last = now, s, now
        return alpha, scale, seen

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions, and the log10 likelihood."""
        alpha, scale, back = self.forward(model)
        back /= scale[:, None]  # becomes emission * beta / scale
        gamma = np.empty_like(alpha)
        turn = np.ascontiguousarray(model.move.T)
        beta = np.ones((0, alpha.shape[1]))
        for t in range(self.steps - 1, -1, -1):
            a, b = self.at[t], self.at[t + 1]
            full = np.ones((b - a, alpha.shape[1]))
            full[: len(beta)] = beta
            gamma[a:b] = alpha[a:b] * full
            back[a:b] *= full
            beta = back[a:b] @ turn
        n = self.at[1] if self.steps else 0
        later = np.arange(n, len(alpha))
        before = later - np.repeat(self.live[:-1], self.live[1:]) if self.steps > 1 else later
        moves = model.move * (alpha[before].T @ back[later])
        emits = np.stack([np.bincount(self.symbols, weights=gamma[:, k], minlength=model.emit.shape[1]) for k in range(alpha.shape[1])])
        return gamma[:n].sum(axis=0), moves, emits, float(np.log10(scale).sum())


def _sequences(texts: pa.Array, vocab: Vocabulary):
    """Symbols of the texts with their ends, bounds, and the words' hashes, symbols and counts."""
    words, h = _split(texts)
    symbol, count = vocab.symbols(words, h)
    size = np.diff(words.bounds)
    bounds = words.bounds + np.arange(len(words.bounds))
    out = np.full(len(h) + len(size), vocab.end, dtype=np.int64)
    put = np.ones(len(out), dtype=bool)
    put[bounds[1:] - 1] = False
    out[put] = symbol
    return out, bounds, words, h, symbol, count


_PIECE = 4096
#: expected counts are added as whole numbers of this part of one, so that the order of tasks does not matter; 10 ** 13 tokens fit
_UNIT = float(1 << 18)


def _width(vocab: Vocabulary) -> str:
    return "<u2" if vocab.end < 1 << 16 else "<u4"


def _symbols(train: DataFrame, shared_vocab) -> DataFrame:
    """The symbols of every document with its end, a row each: all that Baum-Welch reads, written once for all passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared_vocab.value
        kind = np.dtype(_width(voc))
        for batch in batches:
            for part in K.bites(batch, "text", _LATTICE_BYTES):
                seq, bounds, *_ = _sequences(part.column("text"), voc)
                cuts, data = (bounds * kind.itemsize).astype(np.int32), seq.astype(kind)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])], names=["symbols"])

    return arrow_map(train.select("text"), run, "symbols binary")


def baum_welch(train: DataFrame, vocab: Vocabulary, states: int = 8, passes: int = 4, seed: int = 11, prior_tokens: float = 200.0) -> Model:
    """Baum-Welch passes over all training documents."""
    spark = train.sparkSession
    model, symbols = first_guess(vocab, states, seed), vocab.own + TAILS + 1
    shared_vocab = spark.sparkContext.broadcast(vocab)
    laid = stash(_symbols(train, shared_vocab), "symbols")
    kind = np.dtype(_width(vocab))
    prior = (vocab.weight + 1) / (vocab.weight + 1).sum()
    schema = "piece long, sums binary"
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total = np.zeros(states + states * states + states * symbols)
            for batch in batches:
                for part in K.bites(batch, "symbols", _SYMBOL_BYTES):
                    held = part.column("symbols")
                    cuts = K.flat_offsets(held) // kind.itemsize
                    seq = np.frombuffer(held.buffers()[2], dtype=kind, count=int(cuts[-1]))[cuts[0] :].astype(np.int64)
                    start, move, emit, _ = Lattice(seq, cuts - cuts[0]).expected(now)
                    total += np.concatenate((start, move.ravel(), emit.ravel()))
            if total.any():
                for i in range(0, len(total), _PIECE):
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int64()), "sums": pa.array([np.rint(total[i : i + _PIECE] * _UNIT).astype("<i8").tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, raw in zip(batch.column("piece").to_pylist(), batch.column("sums").to_pylist()):
                    held[i] = held.get(i, 0) + np.frombuffer(raw, dtype="<i8")
            for i, x in held.items():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int64()), "sums": pa.array([x.tobytes()], pa.binary())})

        rows = arrow_map(arrow_map(laid, run, schema).repartition(16, "piece"), add, schema).toArrow()
        total = np.zeros(states + states * states + states * symbols)
        for i, raw in zip(rows.column("piece").to_pylist(), rows.column("sums").to_pylist()):
            total[i : i + _PIECE] = np.frombuffer(raw, dtype="<i8") / _UNIT
        shared.unpersist()
        start, move, emit = total[:states] + 1, total[states : states + states * states].reshape(states, states) + 1, total[states + states * states :].reshape(states, symbols) + prior_tokens * prior
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    discard(laid)
    return model


_SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, forward double, rare array<long>, times array<int>"


def _score(docs: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """What a text's score needs besides the counts of words that are not among the known, and those words."""
    sc = docs.sparkSession.sparkContext
    shared, shared_vocab = sc.broadcast(model), sc.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, now, voc = row_ids(), shared.value, shared_vocab.value
        for batch in batches:
            for part in K.bites(batch, "text", _LATTICE_BYTES):
                seq, bounds, words, h, symbol, count = _sequences(part.column("text"), voc)
                lattice, n = Lattice(seq, bounds), part.num_rows
                _, scale, _ = lattice.forward(now)
                per_token = np.log10(scale[lattice.place]) - voc.inside[seq]
                doc = words.docs()
                add = lambda x: np.bincount(doc, weights=x, minlength=n).astype(np.float64)
                logs = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                rare = count < 0
                key = np.stack((doc[rare].astype(np.int64), h[rare]))
                order = np.lexsort((key[1], key[0]))
                key = key[:, order]
                first = np.ones(key.shape[1], dtype=bool)
                first[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
                at = np.flatnonzero(first)
                times = np.diff(np.append(at, key.shape[1])).astype(np.int32)
                cut = pa.array(np.searchsorted(key[0][at], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(ids) for _ in range(n)], pa.int64()), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(bounds), pa.int64()),
                        pa.array(add(count > 0).astype(np.int64) + int(voc.end_count > 0)), pa.array(add(logs) + np.log10(voc.end_count + 1.0)), pa.array(add(np.where(symbol >= voc.own, logs, 0.0))),
                        pa.array(np.add.reduceat(per_token, bounds[:-1]) if n else np.zeros(0)), pa.ListArray.from_arrays(cut, pa.array(key[1][at])), pa.ListArray.from_arrays(cut, pa.array(times)),
                    ],
                    names=[x.split()[0] for x in _SCORED.split(", ")],
                )

    return arrow_map(docs, run, _SCORED)


def scores(docs: DataFrame, states: int = 8, passes: int = 4, own: int = OWN) -> DataFrame:
    """own: words that states emit themselves.  doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row."""
    texts = _prepared(docs)
    train = texts.filter("NOT held_out")
    counts = stash(count_words(train), "counts")
    vocab = vocabulary(counts, train.count(), own)
    model = baum_welch(train, vocab, states, passes)
    scored = stash(_score(texts, vocab, model), "scored")
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    rare = rare.join(counts.select("h", "c"), "h").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(rare, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(vocab.total + vocab.distinct + 1)))).alias("base_score"),
        (F.col("forward") + F.col("own") + more).alias("score"),
    )
