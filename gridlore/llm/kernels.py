"""Vectorised text kernels over Arrow string buffers.

Every kernel works on the UTF-8 bytes of a whole Arrow batch at once, so no
Python object is made per word.  Word patterns of the contracts treat all bytes
from 0x80 up alike, so byte classes give the same words as code-point classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_M3 = np.uint64(0x9E3779B97F4A7C15)
_S29, _S32, _S33 = np.uint64(29), np.uint64(32), np.uint64(33)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words `[^\x20\x09-\x0D]+`
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower case already
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_PAD = 8


@dataclass
class Words:
    """Words of the documents of one batch; document d has words bounds[d]:bounds[d + 1]."""

    data: np.ndarray  # the batch's bytes, 8 zero bytes after them
    offsets: np.ndarray  # byte offsets of the documents
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def arrow(self) -> pa.LargeBinaryArray:
        """The words themselves, without copying more than their bytes."""
        return spans(self.data, self.starts, self.ends)


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (with padding) and each text's offset; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.zeros(last - first + _PAD, dtype=np.uint8)
    if last > first:
        data[:-_PAD] = np.frombuffer(held, dtype=np.uint8)[first:last]
    return data, offsets - first


def split_words(texts: pa.Array, kind: np.ndarray, lower: bool) -> Words:
    """Words of every text: maximal runs of bytes of a kind, none across two texts."""
    data, offsets = flat(texts)
    if lower:
        data = LOWER[data]
    n = len(data) - _PAD
    inside = kind[data[:n]]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The byte spans as an Arrow array; spans do not overlap and ascend."""
    size = ends - starts
    where = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(size, out=where[1:])
    change = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(change, starts, 1) if len(starts) and size.min() == 0 else change.__setitem__(starts, 1)
    change[ends] -= 1
    kept = data[np.cumsum(change[:-1], dtype=np.int8).astype(bool)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(kept)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, in place."""
    h ^= h >> _S33
    h *= _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S32
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a round; data ends with padding."""
    size = (ends - starts).astype(np.int64)
    h = (size.astype(np.uint64) + np.uint64(seed)) * _M3
    if not len(starts):
        return h
    at = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    left, pos, live = size, starts.astype(np.int64), None
    while True:
        part = at[pos] & _KEEP[np.minimum(left, 8)]
        if live is None:
            h ^= part
            mix(h)
        else:
            h[live] = mix((h[live] * _M3) ^ part)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live = more if live is None else live[more]
        left, pos = left[more] - 8, pos[more] + 8


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    return hash_spans(words.data, words.starts, words.ends, seed)


def hash_grams(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k consecutive numbers (len(ids) - k + 1 of them, or none)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = ids[:n].astype(np.uint64, copy=True)
    for j in range(1, k):
        h *= _M3
        h += ids[j : j + n]
        h ^= h >> _S32
    return mix(h)


def grams_inside(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts (word indexes) of the k-grams that lie within one document."""
    total = int(bounds[-1])
    if total < k:
        return np.zeros(0, dtype=np.int64)
    ok = np.ones(total, dtype=bool)
    for j in range(1, k):
        at = bounds[1:] - j
        ok[at[at >= 0]] = False
    # what a short document marks of the one before it, that one's own end marks too
    return np.flatnonzero(ok)


def cover(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in [start, start + width) of any start."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    change = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def bites(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a text column (at least one row each), so that a kernel's arrays stay small."""
    texts = batch.column(column)
    size = np.cumsum(np.diff(flat_offsets(texts)))
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def flat_offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
