"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Texts are byte strings put one after another: symbol 0 ends the whole, 1 each
text, byte b is b + 2.  Buckets are induced one symbol at a time, each as a few
array operations, so the work is linear with a small constant.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

SYMBOLS = 258


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last one counts as smaller)."""
    n = len(s)
    step = np.diff(s.astype(np.int32))
    where = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(where[::-1])[::-1]
    out = np.ones(n, dtype=bool)
    out[:-1] = step[np.minimum(following, n - 2)] > 0 if n > 1 else True
    return out


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that an order of the leftmost-smaller suffixes induces."""
    n = len(s)
    count = np.bincount(s, minlength=SYMBOLS)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, dtype=np.int64)
    symbol = s[lms]
    order = np.argsort(symbol, kind="stable")
    n_lms = np.bincount(symbol, minlength=SYMBOLS)
    first = np.cumsum(n_lms) - n_lms
    sa[(end - n_lms - first)[symbol[order]] + np.arange(len(lms))] = lms[order]
    head = start.copy()

    def push(items: np.ndarray) -> None:
        p = items - 1
        p = p[p >= 0]
        p = p[~small[p]]
        if not len(p):
            return
        c = s[p]
        order = np.argsort(c, kind="stable")
        many = np.bincount(c, minlength=SYMBOLS)
        sa[(head - np.cumsum(many) + many)[c[order]] + np.arange(len(p))] = p[order]
        np.add(head, many, out=head)

    used = np.flatnonzero(count)
    for c in used:
        low = start[c]
        while low < head[c]:
            items, low = sa[low : head[c]], head[c]
            push(items)
        if n_lms[c]:
            push(sa[end[c] - n_lms[c] : end[c]])
    tail = end.copy()
    sa[0] = n - 1
    tail[0] = 0

    def pull(items: np.ndarray) -> None:
        p = items[::-1] - 1
        p = p[p >= 0]
        p = p[small[p]]
        if not len(p):
            return
        c = s[p]
        order = np.argsort(c, kind="stable")
        many = np.bincount(c, minlength=SYMBOLS)
        sa[(tail - 1 + np.cumsum(many) - many)[c[order]] - np.arange(len(p))] = p[order]
        np.subtract(tail, many, out=tail)

    for c in used[::-1]:
        high = end[c]
        while tail[c] < high and c:
            items, high = sa[tail[c] : high], tail[c]
            pull(items)
        if c == 0:
            pull(sa[:1])
        elif head[c] > start[c]:
            pull(sa[start[c] : head[c]])
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names; only what is still tied is sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied, k = order[~(new & np.append(new[1:], True))], 1
    while len(tied):
        ahead = tied + k
        key = rank[tied] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        old = rank[tied]
        here = np.arange(len(tied))
        group, sub = np.ones(len(tied), dtype=bool), np.ones(len(tied), dtype=bool)
        group[1:], sub[1:] = old[1:] != old[:-1], key[1:] != key[:-1]
        rank[tied] = old + np.maximum.accumulate(np.where(sub, here, 0)) - np.maximum.accumulate(np.where(group, here, 0))
        tied = tied[~(sub & np.append(sub[1:], True))]
        k *= 2
    return rank


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of symbols (uint16, below SYMBOLS) that end with the only 0."""
    if len(s) < 3:
        return np.argsort(s, kind="stable")
    small = _types(s)
    is_lms = np.zeros(len(s), dtype=bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        # leftmost-smaller substrings, sorted by inducing from them unsorted, get names; their string is sorted in turn
        sa = _induce(s, small, lms)
        ordered = sa[is_lms[sa]]
        until = np.append(lms[1:], lms[-1])
        index = np.empty(len(s), dtype=np.int64)
        index[lms] = np.arange(len(lms))
        raw = np.concatenate((s.view(np.uint8), np.zeros(8, dtype=np.uint8)))
        code = K.hash_spans(raw, 2 * lms, 2 * until + 2)[index[ordered]]
        differ = np.ones(len(lms), dtype=np.int64)
        differ[1:] = code[1:] != code[:-1]
        names = np.empty(len(lms), dtype=np.int64)
        names[index[ordered]] = np.cumsum(differ) - 1
        lms = lms[np.argsort(_by_doubling(names), kind="stable")] if differ.sum() < len(lms) else ordered
    return _induce(s, small, lms)


def common_prefixes(s: np.ndarray, sa: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the suffix before its own in order, and how many symbols they share.

    Where the symbols before two such places are equal, the common prefix is the
    one before, less one; only the other places, and `fresh`, are compared, up to
    `most` symbols.  So counts are exact below `most` within what follows a fresh
    place for at most `most` symbols.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, dtype=bool)
    own[1:] = (before[1:] <= 0) | (s[:-1] != s[before[1:] - 1])
    own[fresh] = True
    at = np.flatnonzero(own & (before >= 0))
    padded = np.concatenate((s, np.zeros(4 + most, dtype=np.uint16)))
    words = np.ndarray((len(padded) - 3,), dtype="<u8", buffer=padded, strides=(2,))
    i, j = at, before[at]
    shared = np.zeros(len(at), dtype=np.int64)
    live = np.arange(len(at))
    length = 0
    while len(live) and length < most:
        x = words[np.minimum(i[live] + length, len(words) - 1)] ^ words[np.minimum(j[live] + length, len(words) - 1)]
        stop = x != 0
        low = x[stop]
        low &= ~low + np.uint64(1)  # the lowest bit that differs
        shared[live[stop]] = length + (np.log2(low.astype(np.float64)).astype(np.int64) >> 4)
        live = live[~stop]
        length += 4
    shared[live] = most
    value = np.zeros(n, dtype=np.int64)
    value[at] = shared
    source = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return before, np.maximum(value[source] - (np.arange(n) - source), 0)


def repeated(texts: list[bytes], window: int, most: int) -> list[np.ndarray]:
    """For each text the starts of its windows of `window` bytes that also start elsewhere in these texts; no text is longer than `most` bytes."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(size + 1) - size - 1
    joined = np.frombuffer(b"\x00".join(texts) + b"\x00\x00", dtype=np.uint8)
    s = joined.astype(np.uint16) + np.uint16(2)
    s[start + size] = 1
    s[-1] = 0
    sa = suffix_array(s)
    before, shared = common_prefixes(s, sa, start, most + 2)
    place = np.arange(len(s))
    owner = np.minimum(np.searchsorted(start, place, side="right") - 1, len(texts) - 1)
    good = np.minimum(shared, start[owner] + size[owner] - place) >= window
    marked = good.copy()
    marked[before[good]] = True
    return [np.flatnonzero(marked[a : a + n]) for a, n in zip(start, size)]
