"""Suffix arrays by induced sorting, and permuted longest common prefixes.

The order of the suffixes that are smaller than both neighbours' starts (the
leftmost smaller ones, LMS) induces the order of all others in linear time.
Passes over a small alphabet handle a bucket at a time with numpy; passes over
a large one (the names of a recursion) go suffix by suffix."""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 6_000   # symbols, up to which a pass goes by buckets


def _kinds(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is."""
    n = len(t)
    up = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        following = differs[np.searchsorted(differs, np.arange(n - 1))]   # the sentinel differs from all
        up[:-1] = t[following] < t[following + 1]
    return up


def _by_bucket(t, up, starts, ends, seeds) -> np.ndarray:
    n = len(t)
    sa = np.full(n, -1, np.int64)
    seed_at = np.searchsorted(t[seeds], np.arange(len(starts) + 1))
    head, tail = starts.copy(), ends.copy()
    used = np.flatnonzero(ends > starts)

    def groups(j):
        ch = t[j]
        if len(j) > 1:
            order = np.argsort(ch, kind="stable")
            j, ch = j[order], ch[order]
        first = np.concatenate(([0], np.flatnonzero(ch[1:] != ch[:-1]) + 1))
        count = np.diff(np.append(first, len(j)))
        rank = np.arange(len(j)) - np.repeat(first, count)
        return j, ch, rank, ch[first], count

    def larger(block):
        j = block[block > 0] - 1
        j = j[~up[j]]
        if len(j):
            j, ch, rank, chars, count = groups(j)
            sa[head[ch] + rank] = j
            head[chars] += count

    def smaller(block):
        j = block[block > 0] - 1
        j = j[up[j]]
        if len(j):
            j, ch, rank, chars, count = groups(j)
            sa[tail[ch] - 1 - rank] = j
            tail[chars] -= count

    for c in used.tolist():
        done = starts[c]
        while done < head[c]:
            block, done = sa[done:head[c]].copy(), head[c]
            larger(block)
        if seed_at[c] < seed_at[c + 1]:
            larger(seeds[seed_at[c]:seed_at[c + 1]])
    sa[0], tail[t[n - 1]] = n - 1, 0
    for c in used[::-1].tolist():
        done = ends[c]
        while done > tail[c]:
            block, done = sa[tail[c]:done][::-1].copy(), tail[c]
            smaller(block)
        if starts[c] < head[c]:
            smaller(sa[starts[c]:head[c]][::-1].copy())
    return sa


def _one_by_one(t, up, starts, ends, seeds) -> np.ndarray:
    n = len(t)
    # the symbol before each suffix if that one is larger (smaller) than it, else -1; place n stands for none
    before = np.concatenate(([-1], t[:-1], [-1])).astype(np.int64)
    is_up = np.concatenate(([True], up[:-1], [True]))
    larger = np.where(is_up, -1, before).tolist()
    smaller = np.where(is_up, before, -1).tolist()
    chars = t[seeds]
    first = np.searchsorted(chars, chars, side="left")
    last = np.searchsorted(chars, chars, side="right")
    place = np.full(n, n, np.int64)
    place[ends[chars] - (last - first) + np.arange(len(seeds)) - first] = seeds
    sa = place.tolist()
    head = starts.tolist()
    for i in sa:                                   # the list grows ahead of the reading place
        c = larger[i]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    tail = ends.tolist()
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            k = tail[c] - 1
            sa[k] = i - 1
            tail[c] = k
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of ``t``, numbers below ``symbols`` whose last one is 0 and stands nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    up = _kinds(t)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    counts = np.bincount(t, minlength=symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    induce = _by_bucket if symbols <= SMALL_ALPHABET else _one_by_one
    order = induce(t, up, starts, ends, lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    # name the LMS substrings: neighbours in order are equal if they have the same length and symbols
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms), 0) + 1
    differ = length[ranked[1:]] != length[ranked[:-1]]
    a, b = ranked[:-1], ranked[1:]
    open_ = np.flatnonzero(~differ)
    k = 0
    while len(open_):
        unequal = t[a[open_] + k] != t[b[open_] + k]
        differ[open_[unequal]] = True
        k += 1
        open_ = open_[~unequal]
        open_ = open_[length[a[open_]] > k]
    names = np.concatenate(([0], np.cumsum(differ)))
    if names[-1] + 1 < len(lms):
        name = np.zeros(n, np.int64)
        name[ranked] = names
        ranked = lms[suffix_array(name[lms], int(names[-1]) + 1)]
    return induce(t, up, starts, ends, ranked)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``phi`` (the suffix before each suffix in order; -1 for the first) and
    the length of the prefix that each suffix shares with it, by text place.

    Only where the symbols before the two differ is the length compared;
    everywhere else it is one less than at the place before."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    at = np.flatnonzero((phi > 0) & (np.arange(n) > 0))
    fresh[at] = t[at - 1] != t[phi[at] - 1]
    lcp = np.zeros(n, np.int64)
    a = np.flatnonzero(fresh & (phi >= 0))
    b = phi[a]
    padded = np.concatenate((t, np.full(16, -1, t.dtype)))     # unequal past the end: the last symbol is unique
    step = 8
    words = [padded[k:k + n] for k in range(step)]
    found = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        x, y = a[open_] + found[open_], b[open_] + found[open_]
        same = np.ones(len(open_), bool)
        more = np.zeros(len(open_), np.int64)
        for w in words:
            same &= w[np.minimum(x, n - 1)] == w[np.minimum(y, n - 1)]
            if not same.any():
                break
            more += same
        found[open_] += more
        open_ = open_[more == step]
    lcp[a] = found
    index = np.arange(n)
    last = np.maximum.accumulate(np.where(fresh, lcp + index, 0))
    return phi, np.maximum(last - index, 0)


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of its ``length``-byte strings that also start
    at another place of the same or another text."""
    return _repeated([np.frombuffer(x, np.uint8).astype(np.int32) for x in texts], 256, length)


def repeated_starts_around(texts: list[bytes], cores: list[int], size: int, length: int) -> list[np.ndarray]:
    """The same for texts of which every ``length``-byte string holds the
    ``size`` bytes from ``cores[i]`` on: these stand in the array as one symbol
    that equal cores share, so the array is over the bytes around them only."""
    numbers: dict[bytes, int] = {}
    rows = []
    for x, at in zip(texts, cores, strict=True):
        core = numbers.setdefault(x[at:at + size], 256 + len(numbers))
        row = np.empty(len(x) - size + 1, np.int32)
        row[:at] = np.frombuffer(x, np.uint8, at)
        row[at] = core
        row[at + 1:] = np.frombuffer(x, np.uint8, len(x) - at - size, at + size)
        rows.append(row)
    return _repeated(rows, 256 + len(numbers), length - size + 1)


def _repeated(rows: list[np.ndarray], symbols: int, length: int) -> list[np.ndarray]:
    m = len(rows)
    sizes = np.array([len(x) for x in rows], np.int64)
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)))
    t = np.zeros(int(firsts[-1]) + 1, np.int32)
    inside = np.ones(len(t), bool)
    inside[firsts[1:] - 1] = inside[-1] = False
    t[inside] = np.concatenate(rows) + (m + 1)
    t[firsts[1:] - 1] = np.arange(1, m + 1)          # a symbol of its own ends each row
    phi, lcp = common_prefixes(t, suffix_array(t, m + 1 + symbols))
    again = lcp >= length
    hit = again.copy()
    hit[phi[again]] = True
    return [np.flatnonzero(hit[firsts[i]:firsts[i] + sizes[i]]) for i in range(m)]
