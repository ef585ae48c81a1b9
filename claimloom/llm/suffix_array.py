"""Suffix arrays of a shard by induced sorting, and permuted common prefixes, in array operations."""

from __future__ import annotations

import numpy as np

#: A reduced string of more names than this is sorted by rank doubling: induction goes through its alphabet name by name.
NAMES = 2048


def _grouped(chars):
    """A stable order by character, and each one's place among its equals in that order."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    return order, c, np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))


def _induce(s, is_s, lms, start, end, lms_count):
    """All suffixes in order, from the leftmost-smaller ones in order: left to right for the larger type, then back for the smaller."""
    n, sigma = len(s), len(start)
    sa = np.full(n, -1, np.int64)
    order, c, nth = _grouped(s[lms])
    sa[end[c] - lms_count[c] + nth] = lms[order]
    head = start.copy()

    def larger(chunk):
        j = chunk - 1
        j = j[(j >= 0) & ~is_s[j]]
        if len(j):
            order, c, nth = _grouped(s[j])
            sa[head[c] + nth] = j[order]
            head[:] += np.bincount(c, minlength=sigma)

    full = np.flatnonzero(end > start)
    for c in full:
        at = start[c]
        while at < head[c]:  # suffixes that this bucket gives itself come in rounds
            at, chunk = head[c], sa[at : head[c]]
            larger(chunk)
        if lms_count[c]:
            larger(sa[end[c] - lms_count[c] : end[c]])
    tail = end.copy()
    tail[0] = start[0] + 1 if sigma else 0  # the sentinel stays

    def smaller(chunk):
        j = chunk - 1
        j = j[(j >= 0) & is_s[j]]
        if len(j):
            order, c, nth = _grouped(s[j])
            sa[tail[c] - 1 - nth] = j[order]
            tail[:] -= np.bincount(c, minlength=sigma)

    for c in full[::-1]:
        if c == 0:
            smaller(sa[:1])
            continue
        at = end[c]
        while at > tail[c]:
            at, chunk = tail[c], sa[tail[c] : at][::-1]
            smaller(chunk)
        if head[c] > start[c]:
            smaller(sa[start[c] : head[c]][::-1])
    return sa


def suffix_array(s, sigma: int, depth: int | None = None):
    """Suffixes of s in order; s ends with its only 0, the least. Ties beyond `depth` symbols may stand in any order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    apart = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    nxt = apart[np.searchsorted(apart, np.arange(n))]
    is_s = np.append(s[:-1] < s[1:], True)[nxt]
    is_lms = np.append(False, is_s[1:] & ~is_s[:-1])
    lms = np.flatnonzero(is_lms)
    count = np.bincount(s, minlength=sigma)
    end = np.cumsum(count)
    start = end - count
    lms_count = np.bincount(s[lms], minlength=sigma)
    sa = _induce(s, is_s, lms, start, end, lms_count)
    sorted_lms = sa[is_lms[sa]]
    # name the leftmost-smaller substrings: equal ones stand side by side now
    size = np.zeros(n, np.int64)
    size[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = size[a] == size[b]
    left, k = np.flatnonzero(same), 0
    while len(left):
        equal = s[a[left] + k] == s[b[left] + k]
        same[left[~equal]] = False
        k += 1
        left = left[equal & (size[a[left]] > k)]
    name = np.zeros(n, np.int64)
    name[sorted_lms] = np.cumsum(np.append(0, ~same))
    names = int(name[sorted_lms[-1]]) + 1
    reduced = name[lms]
    if names == len(lms):
        in_order = sorted_lms  # all substrings differ
    elif names <= NAMES:
        in_order = lms[suffix_array(reduced, names, depth)]
    else:
        in_order = lms[_doubled(reduced, depth)]
    return _induce(s, is_s, in_order, start, end, lms_count)


def _doubled(rank, depth: int | None):
    """Suffixes of rank in order of their first `depth` symbols at least, by doubling the length that ranks stand for."""
    n, k = len(rank), 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        kinds, rank = np.unique(key, return_inverse=True)
        k *= 2
        if len(kinds) == n or k >= n or depth and k >= depth:
            return np.argsort(rank, kind="stable")


def permuted_prefixes(raw, order, depth: int):
    """For each place in order, in text order: bytes, up to depth, that its suffix shares with the one before it in order.

    raw has depth + 8 bytes after the last place. Places not in order have -1.
    """
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = np.full(len(raw), -1, np.int64)
    if not len(order):
        return out
    a, b = order[:-1], order[1:]
    common = np.zeros(len(b), np.int64)
    left = np.arange(len(b))
    for at in range(0, depth, 8):
        diff = words[a[left] + at] ^ words[b[left] + at]
        equal = diff == 0
        low = diff[~equal]
        common[left] += 8
        common[left[~equal]] += (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3) - 8
        left = left[equal]
    out[order[0]] = 0
    out[b] = np.minimum(common, depth)
    return out
