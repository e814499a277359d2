"""Quality rules: a short-circuit cascade ordered by rejections per cost.

Each rule's cost (seconds a document) and selectivity (share it rejects) are
measured on a sample; rules then run in descending order of rejections per
second, each only on the documents that no earlier rule has rejected.  The
order changes the work, never the verdict: a document is kept exactly if no
rule rejects it.

Defined cases: a null or empty text has no words and fails ``too_short``; very
long texts are read whole; repeated rows get equal results, one each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_map, texts_only

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
WINDOW = 8


class Texts:
    """Counts of a batch of texts, each made when a rule first asks for it."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.n = len(texts)

    def take(self, rows: np.ndarray) -> Texts:
        return Texts(self.texts.take(pa.array(rows)))

    @cached_property
    def words(self) -> K.Words:
        return K.split_words(self.texts, K.NON_SPACE, lower=False)

    def _sum(self, flags: np.ndarray) -> np.ndarray:
        """Marked bytes of each text."""
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[self.words.offsets])

    @cached_property
    def _bytes(self) -> np.ndarray:
        return self.words.data[: int(self.words.offsets[-1])]

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.bounds)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._sum(K.NON_SPACE[self._bytes] & ((self._bytes & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._sum(_SYMBOL[self._bytes])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._sum(_UPPER[self._bytes])

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self._sum(_LETTER[self._bytes])

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines that hold a word, and those equal to an earlier line, of each text."""
        w, data = self.words, self._bytes
        ends = np.union1d(np.flatnonzero(data == 0x0A), w.offsets[1:])  # the end of a text is that of its last line
        starts = np.concatenate(([0], ends[:-1]))
        starts = starts + (starts < len(data)) * (data[np.minimum(starts, max(len(data) - 1, 0))] == 0x0A) if len(data) else starts
        starts = np.minimum(starts, ends)
        inside = np.concatenate(([0], np.cumsum(K.NON_SPACE[data], dtype=np.int64)))
        used = inside[ends] > inside[starts]
        starts, ends = starts[used], ends[used]
        doc = np.searchsorted(w.offsets, starts, side="right") - 1
        own = K.mix(K.hash_spans(w.data, starts, ends) ^ K.mix(doc.astype(np.uint64) + np.uint64(1)))
        first = np.unique(own, return_index=True)[1]
        n = np.bincount(doc, minlength=self.n)
        return n, n - np.bincount(doc[first], minlength=self.n)

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        at = K.grams_inside(w.bounds, WINDOW)
        if not len(at):
            return np.zeros(self.n, dtype=np.int64)
        own = K.hash_grams(K.hash_words(w), WINDOW)[at]
        own = K.mix(own ^ K.mix(w.docs()[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = K.cover(len(w), at[twice], WINDOW)
        return np.diff(np.concatenate(([0], np.cumsum(covered)))[w.bounds])


@dataclass(frozen=True)
class Rule:
    """rejects(texts) marks the documents that fail."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The production rules. The first two are the contract's base; the others aim at markup debris, tables flattened to separators and shouting.
RULES: tuple[Rule, ...] = (
    Rule("too_short", lambda t: t.n_words < 20),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 25 * t.n_words)),
    Rule("capitals", lambda t: (2 * t.n_upper > t.n_letters) & (t.n_letters >= 20)),
    Rule("same_lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
)
BASE = ("too_short", "repeats")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Measured:
    name: str
    cost: float  # seconds a document
    selectivity: float  # share of documents rejected

    @property
    def rank(self) -> float:
        return self.selectivity / max(self.cost, 1e-12)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, seed: int = 7) -> list[Measured]:
    """Cost and selectivity of each rule on about sample_rows rows; executors measure, the driver gets one row a rule and batch.

    The split words, which the rules of a cascade share, are made before the clock starts.

    Only the order of the cascade comes from this, so a small sample is enough.
    """
    total = docs.count()
    share = min(1.0, 1.5 * sample_rows / max(total, 1))
    picked = texts_only(docs, "doc_id", "text").select("text").sample(False, share, seed).limit(sample_rows)
    rules = tuple(rules)

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.bites(batch, "text"):
                split = Texts(part.column("text"))
                split.words  # noqa: B018
                for rule in rules:
                    texts = copy.copy(split)
                    began = time.perf_counter()
                    failed = int(rule.rejects(texts).sum())
                    yield pa.RecordBatch.from_pydict({"rule": [rule.name], "s": [time.perf_counter() - began], "failed": [failed], "n": [texts.n]})

    got = {r["rule"]: r for r in arrow_map(picked, trial, "rule string, s double, failed long, n long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("failed").alias("failed"), F.sum("n").alias("n")).collect()}
    return [Measured(r.name, got[r.name]["s"] / got[r.name]["n"], got[r.name]["failed"] / got[r.name]["n"]) if r.name in got else Measured(r.name, 0.0, 0.0) for r in rules]


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> list[Rule]:
    """The rules by descending rejections per second; equal ranks keep their order."""
    rank = {m.name: m.rank for m in measure(docs, rules, sample_rows)}
    return sorted(rules, key=lambda r: -rank[r.name])


def cascade(texts: pa.Array, rules: Sequence[Rule]) -> tuple[np.ndarray, Texts]:
    """For each text the index of the first rule that rejects it, or -1; a rule sees only what is left."""
    whole = view = Texts(texts)
    verdict = np.full(whole.n, -1, dtype=np.int64)
    left = np.arange(whole.n)
    for k, rule in enumerate(rules):
        if not len(left):
            break
        bad = np.asarray(rule.rejects(view), dtype=bool)
        verdict[left[bad]] = k
        if bad.any():
            left = left[~bad]
            # counts already made are worth more than a smaller copy unless much has gone
            if 2 * len(left) < view.n:
                view = whole.take(left)
            else:
                view = _Rest(view, np.flatnonzero(~bad))
    return verdict, whole


class _Rest:
    """What is left of a batch, on the counts of the whole batch."""

    def __init__(self, base, rows: np.ndarray):
        self._base, self._rows, self.n = base, rows, len(rows)

    def __getattr__(self, name: str):
        return getattr(self._base, name)[self._rows]


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, counts: bool = False) -> DataFrame:
    """doc_id, rejected_by (null: kept) and, if asked for, the counts of every document (which end the short circuit)."""
    order = tuple(rules or plan(docs))
    names = pa.array([r.name for r in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.bites(batch, "text"):
                verdict, texts = cascade(part.column("text"), order)
                by = names.take(pa.array(verdict, mask=verdict < 0))
                out = {"doc_id": part.column("doc_id"), "rejected_by": by}
                if counts:
                    out |= {c: pa.array(getattr(texts, c), pa.int64()) for c in COUNTS}
                yield pa.RecordBatch.from_pydict(out)

    return arrow_map(texts_only(docs, "doc_id", "text"), run, "doc_id long, rejected_by string" + "".join(f", {c} long" for c in COUNTS if counts))


def keep(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they are."""
    order = tuple(rules or plan(docs))
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.bites(batch, "text"):
                verdict, _ = cascade(part.column("text"), order)
                yield part.filter(pa.array(verdict < 0))

    return arrow_map(docs, run, fields)
