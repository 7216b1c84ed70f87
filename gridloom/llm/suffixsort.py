"""Suffix arrays by induced sorting, and permuted longest common prefixes, as NumPy passes.

The text is sorted by its leftmost S-type (LMS) suffixes as usual; what a sequential scan would do one
suffix at a time is done for the bytes of a text for a bucket's whole frontier at once: the suffixes that a bucket holds
induce their predecessors together, and predecessors in the same bucket form the next frontier. A frontier's
number within a bucket is bounded by the longest run of one character. Reduced texts, at every level of the recursion, are scanned in turn.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for S-type: smaller than the suffix after it. The last character must be a unique least one."""
    step = np.sign(np.diff(s.astype(np.int64)))
    n = len(s)
    nxt = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1), n - 1)[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = np.append(step, 1)[nxt] > 0
    return out


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The suffix array that the LMS suffixes in the given order induce."""
    n, ends = len(s), np.cumsum(counts)
    heads = ends - counts
    sa = np.full(n, -1, np.int64)
    small = s.astype(np.uint16) if len(counts) <= 1 << 16 else s

    def put(found: np.ndarray, at: np.ndarray, step: int) -> None:
        if not len(found):
            return
        c = small[found]
        order = np.argsort(c, kind="stable")
        found, c = found[order], c[order]
        new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        sizes = np.diff(np.append(new, len(c)))
        own = c[new].astype(np.int64)
        rank = np.arange(len(c)) - np.repeat(new, sizes)
        sa[np.repeat(at[own], sizes) + step * rank] = found
        at[own] += step * sizes

    def before(wave: np.ndarray, wanted: bool) -> np.ndarray:
        j = wave[wave > 0] - 1
        return j[is_s[j] == wanted]

    seeds: dict[int, np.ndarray] = {}
    if len(lms):
        c = small[lms]
        order = np.argsort(c, kind="stable")
        cut = np.flatnonzero(np.append(True, c[order][1:] != c[order][:-1]))
        for part in np.split(lms[order], cut[1:]):
            seeds[int(s[part[0]])] = part
    present = np.flatnonzero(counts)
    fill = heads.copy()
    for c in present:
        done = heads[c]
        while done < fill[c]:
            wave, done = sa[done : fill[c]], fill[c]
            put(before(wave, False), fill, 1)
        if (own := seeds.get(int(c))) is not None:
            put(before(own, False), fill, 1)
    l_end, fill = fill, ends - 1
    for c in present[::-1]:
        done = ends[c] - 1
        while done > fill[c]:
            wave, done = sa[fill[c] + 1 : done + 1][::-1], fill[c]
            put(before(wave, True), fill, -1)
        put(before(sa[heads[c] : l_end[c]][::-1], True), fill, -1)
    if sa[0] < 0:
        sa[0] = n - 1
    return sa


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings in text order; ``order`` has their positions sorted by substring."""
    length = np.empty(len(s), np.int64)
    length[lms] = np.append(np.diff(lms), 1) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    active, at = np.flatnonzero(same), 0
    while len(active):
        x, y = a[active], b[active]
        differ = s[x + at] != s[y + at]
        same[active[differ]] = False
        at += 1
        active = active[~differ & (length[x] > at)]
    name = np.empty(len(s), np.int64)
    name[order] = np.append(0, np.cumsum(~same))
    return name[lms]


def _induce_in_turn(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same, one suffix at a time: for reduced texts, whose buckets are about as many as their suffixes."""
    n, ends = len(s), np.cumsum(counts)
    pred = np.append(s[-1:], s[:-1])
    wanted = np.append(is_s[-1:], is_s[:-1])
    to_l, to_s = np.where(wanted, -1, pred), np.where(wanted, pred, -1)
    to_l[0] = to_s[0] = -1
    to_l, to_s = np.append(to_l, -1), np.append(to_s, -1)  # the last is for places not filled yet, which hold -1
    c = s[lms]
    order = np.argsort(c, kind="stable")
    last = np.append(np.flatnonzero(np.diff(c[order])), len(c) - 1) if len(c) else c
    own = c[order]
    tail = np.empty(len(counts), np.int64)
    tail[own[last]] = last
    sa = np.full(n, -1, np.int64)
    sa[ends[own] - 1 - (tail[own] - np.arange(len(own)))] = lms[order]
    out, fill, to = sa.tolist(), (ends - counts).tolist(), to_l.tolist()
    for p in out:
        k = to[p]
        if k >= 0:
            out[fill[k]] = p - 1
            fill[k] += 1
    fill, to = ends.tolist(), to_s.tolist()
    for p in reversed(out):
        k = to[p]
        if k >= 0:
            fill[k] = at = fill[k] - 1
            out[at] = p - 1
    out[0] = n - 1
    return np.array(out, np.int64)


def _sort(s: np.ndarray, alphabet: int, induce=_induce_in_turn) -> np.ndarray:
    """Classify suffixes, sort the leftmost-smaller substrings by one induction, number them, sort the text of
    their numbers by recursion if any number repeats, and induce all suffixes from that order.

    The last character must be a unique least one. Each level is linear and at most half as long as the one above.
    """
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    counts = np.bincount(s, minlength=alphabet)
    sa = induce(s, is_s, lms, counts)
    mark = np.zeros(n, bool)
    mark[lms] = True
    order = sa[mark[sa]]
    names = _names(s, lms, order)
    top = int(names.max()) + 1 if len(names) else 0
    if top < len(lms):
        order = lms[_sort(names, top)]
    return induce(s, is_s, order, counts)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a uint8 array, without the empty suffix."""
    if not len(text):
        return np.empty(0, np.int64)
    return _sort(np.append(text.astype(np.int64) + 1, 0), 257, _induce)[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """By text position: how many characters its suffix shares with the one before it in ``sa``, at most ``cap``."""
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((text, np.zeros(cap + 16, np.uint8)))
    eight = np.ndarray((n + cap + 8,), "<u8", padded, strides=(1,))
    p = np.flatnonzero(before >= 0)
    q = before[p]
    for at in range(0, cap, 8):
        x = eight[p + at] ^ eight[q + at]
        zero = x == 0
        low = x & (~x + np.uint64(1))
        out[p] += np.where(zero, 8, np.log2(np.maximum(low, 1)).astype(np.int64) >> 3)
        p, q = p[zero], q[zero]
        if not len(p):
            break
    here = np.arange(n)
    room = np.where(before >= 0, n - np.maximum(here, before), 0)
    return np.minimum(np.minimum(out, cap), room)
