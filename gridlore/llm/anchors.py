"""Content-chosen anchors of byte windows.

Each window of ``window`` bytes has an anchor: its least gram of ``gram`` bytes (a multiple of 8),
the first of equals.  Equal windows have equal anchors at equal places, so
windows can be compared group by group of the anchor's gram.  A stretch is a run
of neighbouring windows with one anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import kernels as K

_PLACE_BITS = 24
PIECE = 1 << (_PLACE_BITS - 1)  # bytes worked on at a time


@dataclass
class Stretches:
    doc: np.ndarray
    first: np.ndarray  # byte of the document where the stretch's first window starts
    size: np.ndarray  # bytes that its windows cover
    anchor: np.ndarray  # from `first` to the anchor
    gram: np.ndarray  # hash of the anchor's gram
    content: np.ndarray  # hash of the covered bytes and the anchor's place in them
    at: np.ndarray  # start of the covered bytes in the batch


def _grams(data: np.ndarray, n: int, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each of the first n places; data has padding."""
    at = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = at[:n] * K._M1
    for j in range(8, gram, 8):
        h ^= h >> K._S32
        h += at[j : j + n]
        h *= K._M2
    h ^= h >> K._S29
    h *= K._M3
    h ^= h >> K._S32
    return h


def stretches(data: np.ndarray, offsets: np.ndarray, window: int, gram: int = 32) -> Stretches:
    """All stretches of the documents (data[offsets[d]:offsets[d + 1]]); data ends with 8 bytes of padding."""
    parts = []
    end = int(offsets[-1])
    low = 0
    while low + window <= end:
        high = min(end, low + PIECE)
        parts.append(_piece(data, offsets, low, high, window, gram))
        low = high - window + 1 if high < end else end
    names = Stretches.__dataclass_fields__
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Stretches(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    return Stretches(*(np.concatenate([getattr(p, n) for p in parts]) for n in names))


def _piece(data: np.ndarray, offsets: np.ndarray, low: int, high: int, window: int, gram: int) -> Stretches:
    n = high - low - gram + 1
    grams = _grams(data[low : high + K._PAD], n, gram)
    key = (grams >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)
    key |= np.arange(n, dtype=np.uint64)
    width, reach = window - gram + 1, 1
    while 2 * reach <= width:  # least of `reach` neighbours, doubled
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    anchor = (key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    starts = np.arange(len(anchor), dtype=np.int64)
    doc = _owner(offsets, low, len(starts))
    inside = low + starts + window <= offsets[doc + 1]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    new &= inside
    last = np.ones(len(starts), dtype=bool)
    last[:-1] = new[1:] | ~inside[1:]
    last &= inside
    s, e = np.flatnonzero(new), np.flatnonzero(last)
    at, size, place = low + s, e - s + window, anchor[s] - s
    code = grams[anchor[s]]
    content = K.mix(K.hash_spans(data, at, at + size, 3) ^ (code + place.astype(np.uint64)))
    return Stretches(doc[s], at - offsets[doc[s]], size, place, code, content, at)


def _owner(offsets: np.ndarray, low: int, n: int) -> np.ndarray:
    """The document of each of n bytes from low on."""
    cuts = np.clip(offsets - low, 0, n)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(cuts))
