"""Suffix arrays by induced sorting, and capped permuted common prefixes.

Suffixes are smaller or larger than the next one; where a smaller one follows a larger one begins a leftmost-smaller
substring. These are sorted by one induction, get names, and the string of names is sorted by the same method again,
until all names differ; a second induction then sorts all suffixes. An induction scans the array once from the left
and once from the right. Over bytes, numpy takes all entries of a bucket that are known so far at once (a wave), which
keeps the order of a scan; strings of names have about as many buckets as entries, so there the scans go entry by entry.
"""

from __future__ import annotations

import numpy as np

def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    n = len(t)
    sign = np.full(n, -1, np.int8)
    sign[:-1] = np.where(t[1:] > t[:-1], 1, np.where(t[1:] < t[:-1], -1, 0))
    at = np.where(sign != 0, np.arange(n), n)
    return sign[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    n = len(t)
    counts = np.bincount(t)
    k = len(counts)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.empty(n, np.int64)
    lms_counts = np.bincount(t[sorted_lms], minlength=k)
    lms_begin = ends - lms_counts
    order = np.argsort(t[sorted_lms], kind="stable")
    by_char = sorted_lms[order]
    chars = t[by_char]
    sa[lms_begin[chars] + np.arange(len(chars)) - (np.cumsum(lms_counts) - lms_counts)[chars]] = by_char
    heads = begins.copy()

    def spread(p: np.ndarray, front: bool) -> None:
        if not len(p):
            return
        c = t[p]
        o = np.argsort(c, kind="stable")
        p, c = p[o], c[o]
        got = np.bincount(c, minlength=k)
        rank = np.arange(len(p)) - (np.cumsum(got) - got)[c]
        if front:
            sa[heads[c] + rank] = p
            heads[:] += got
        else:
            sa[tails[c] - 1 - rank] = p
            tails[:] -= got

    def before(cur: np.ndarray, want: bool) -> np.ndarray:
        p = cur[cur > 0] - 1
        return p[small[p] == want]

    spread(np.array([n - 1]), True)
    present = np.flatnonzero(counts)
    for c in present.tolist():
        lo = begins[c]
        while lo < heads[c]:
            cur, lo = sa[lo : heads[c]].copy(), int(heads[c])
            spread(before(cur, False), True)
        if lms_counts[c]:
            spread(before(sa[lms_begin[c] : ends[c]].copy(), False), True)
    tails = ends.copy()
    for c in present[::-1].tolist():
        hi = ends[c]
        while tails[c] < hi:
            cur, hi = sa[tails[c] : hi][::-1].copy(), int(tails[c])
            spread(before(cur, True), False)
        spread(before(sa[begins[c] : heads[c]][::-1].copy(), True), False)
    return sa


def _scan(t: list[int], small: list[bool], lms: list[int], ends: list[int]) -> list[int]:
    """The induction entry by entry; lms in their order, ends: of the buckets."""
    n = len(t)
    sa = [-1] * n
    tails = ends[:]
    for p in reversed(lms):
        c = t[p]
        tails[c] -= 1
        sa[tails[c]] = p
    heads = [0, *ends[:-1]]
    c = t[n - 1]  # the end of the string is smaller than anything
    sa[heads[c]] = n - 1
    heads[c] += 1
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not small[p]:
            c = t[p]
            sa[heads[c]] = p
            heads[c] += 1
    tails = ends[:]
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and small[p]:
            c = t[p]
            tails[c] -= 1
            sa[tails[c]] = p
    return sa


def of_names(t: list[int], names: int) -> list[int]:
    """Suffix array of a string of the names 0..names - 1."""
    n = len(t)
    small = [False] * n
    for i in range(n - 2, -1, -1):
        small[i] = t[i] < t[i + 1] or (t[i] == t[i + 1] and small[i + 1])
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    ends = np.cumsum(np.bincount(t, minlength=names)).tolist()
    guess = _scan(t, small, lms, ends)
    if len(lms) < 2:
        return guess
    stop = dict(zip(lms, [*lms[1:], n], strict=True))  # the last one has no equal: it runs into the end
    name, last, upto, number = {}, -1, -1, -1
    for p in guess:
        if p not in stop:
            continue
        own = stop[p]
        if last < 0 or own == n or upto == n or own - p != upto - last or t[p : own + 1] != t[last : upto + 1]:
            number += 1
        name[p] = number
        last, upto = p, own
    if number + 1 == len(lms):
        return _scan(t, small, list(name), ends)
    order = of_names([name[p] for p in lms], number + 1)
    return _scan(t, small, [lms[i] for i in order], ends)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """t: non-negative integers. The end of the string counts as smaller than anything."""
    t = np.asarray(t)
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t.astype(np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(t, small, lms)
    guess = _induce(t, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = guess[is_lms[guess]]
    # equal substrings get one name; that their first and last bytes are equal settles their types
    place = np.searchsorted(lms, by_substring)
    stop = np.append(lms[1:] + 1, n)[place]
    length = stop - by_substring
    differ = np.ones(len(lms), bool)
    differ[1:] = (length[1:] != length[:-1]) | (place[1:] == len(lms) - 1) | (place[:-1] == len(lms) - 1)
    pair = np.flatnonzero(~differ)
    size = length[pair]
    upto = np.cumsum(size)
    if len(pair):
        inside = np.arange(upto[-1]) - np.repeat(upto - size, size)
        unlike = t[np.repeat(by_substring[pair], size) + inside] != t[np.repeat(by_substring[pair - 1], size) + inside]
        differ[pair] = np.logical_or.reduceat(unlike, upto - size)
    names = np.cumsum(differ) - 1
    if names[-1] + 1 == len(lms):
        return _induce(t, small, by_substring)
    reduced = np.empty(len(lms), np.int64)
    reduced[place] = names
    return _induce(t, small, lms[np.array(of_names(reduced.tolist(), int(names[-1]) + 1))])


def plcp(raw: np.ndarray, sa: np.ndarray, cap: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """For each position (in text order) the common prefix with the suffix before it in the array, at most cap;
    -1 for the first suffix and where not wanted. raw: bytes."""
    n = len(raw)
    previous = np.full(n, -1, np.int64)
    previous[sa[1:]] = sa[:-1]
    out = np.full(n, -1, np.int64)
    at = np.flatnonzero((previous >= 0) & (wanted if wanted is not None else True))
    pad = np.concatenate([raw, np.zeros(cap + 16, np.uint8)]).astype(np.uint64)
    word = pad[:-8].copy()
    for k in range(1, 8):
        word |= pad[k : len(pad) - 8 + k] << np.uint64(8 * k)
    have = np.zeros(len(at), np.int64)
    most = np.minimum(cap, n - np.maximum(at, previous[at]))
    live = np.arange(len(at))
    done = 0
    while len(live) and done < cap:
        diff = word[at[live] + done] ^ word[previous[at[live]] + done]
        same = diff == 0
        low = diff & (~diff + np.uint64(1))
        bits = np.where(same, 64, np.log2(np.maximum(low, 1).astype(float))).astype(np.int64)
        have[live] = done + bits // 8
        live = live[same]
        done += 8
    out[at] = np.minimum(have, most)
    return out
