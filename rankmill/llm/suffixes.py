"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the one behind them. The leftmost S ones
(LMS) are put in order, first by their substrings up to the next one, then, where substrings repeat,
by a suffix array of their names, taken recursively. From them the L and then the S suffixes are
induced bucket by bucket. Strings of few different symbols, such as bytes, are induced by moving whole
bucket parts with numpy; strings of many different names, as in the recursion, symbol by symbol.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last symbol is the sentinel: smallest, and S."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])  # of each suffix but the last: towards the next symbol
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(following, n - 2)] > 0
    return out


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix array from LMS suffixes in order (of their first symbols at least)."""
    n, symbols = len(text), np.flatnonzero(np.diff(bounds))
    out = np.empty(n, np.int64)
    firsts = text[lms]
    order = np.argsort(firsts, kind="stable")
    own_lms = np.split(lms[order], np.searchsorted(firsts[order], symbols[1:]))
    larger: dict[int, list] = {}
    smaller: dict[int, list] = {}

    def spread(found: np.ndarray, into: dict[int, list]) -> None:
        heads = text[found]
        by = np.argsort(heads, kind="stable")
        found, heads = found[by], heads[by]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        for part, head in zip(np.split(found, cuts), heads[np.concatenate([[0], cuts])].tolist() if len(found) else [], strict=False):
            into.setdefault(head, []).append(part)

    for c, stars in zip(symbols.tolist(), own_lms, strict=True):
        parts = larger.pop(c, [])
        front = np.concatenate(parts) if parts else np.empty(0, np.int64)
        grown = [front]
        while len(front):  # suffixes that begin with a run of c
            front = front[front > 0] - 1
            front = front[(text[front] == c) & ~small[front]]
            grown.append(front)
        whole = np.concatenate(grown)
        out[bounds[c] : bounds[c] + len(whole)] = whole
        before = np.concatenate([whole, stars])
        before = before[before > 0] - 1
        spread(before[~small[before] & (text[before] != c)], larger)
    counts = np.bincount(text[~small], minlength=len(bounds) - 1)
    for c in symbols[::-1].tolist():
        # from the end of the bucket on: first what later buckets gave
        parts = smaller.pop(c, [])
        front = np.concatenate(parts) if parts else np.empty(0, np.int64)
        grown = [front]
        while len(front):
            front = front[front > 0] - 1
            front = front[(text[front] == c) & small[front]]
            grown.append(front)
        whole = np.concatenate(grown)
        if c == symbols[0]:
            whole = np.array([n - 1])  # the sentinel
        out[bounds[c + 1] - len(whole) : bounds[c + 1]] = whole[::-1]
        large = out[bounds[c] : bounds[c] + counts[c]][::-1]
        before = np.concatenate([whole, large])
        before = before[before > 0] - 1
        spread(before[small[before] & (text[before] != c)], smaller)
    return out


SPARSE = 0.002  # with more different symbols to a symbol than this, buckets are too small to be moved as arrays


def _induce_each(text: np.ndarray, small: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The same symbol by symbol; what is written ahead of the place read is read in its turn."""
    n = len(text)
    # the symbol before each suffix if the suffix there is to be induced, else -1; the last entry is that of no suffix
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = text[:-1]
    larger, smaller = (np.where(np.concatenate([[False], mask[:-1], [False]]), before, -1).tolist() for mask in (~small, small))
    order = np.argsort(text[lms], kind="stable")
    heads = text[lms][order]
    counts = np.bincount(heads, minlength=len(bounds) - 1)
    first = np.cumsum(counts) - counts
    placed = np.full(n, -1, np.int64)
    placed[bounds[1:][heads] - counts[heads] + np.arange(len(lms)) - first[heads]] = lms[order]  # at the ends of their buckets
    out = placed.tolist()
    head = bounds[:-1].tolist()
    for i in out:
        c = larger[i]
        if c >= 0:
            at = head[c]
            out[at] = i - 1
            head[c] = at + 1
    tail = bounds[1:].tolist()
    for i in reversed(out):
        c = smaller[i]
        if c >= 0:
            at = tail[c] = tail[c] - 1
            out[at] = i - 1
    return np.array(out, np.int64)


def suffix_array(text: np.ndarray, sparse: float = SPARSE) -> np.ndarray:
    """Suffix array of non-negative integers whose last one is a unique smallest sentinel."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text))])
    induce = _induce if len(bounds) - 1 < sparse * n else _induce_each
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        lms = lms[_order(text, induce(text, small, lms, bounds), lms, sparse)]
    return induce(text, small, lms, bounds)


def _order(text: np.ndarray, rough: np.ndarray, lms: np.ndarray, sparse: float) -> np.ndarray:
    """Indexes into ``lms`` in the order of their suffixes; ``rough`` has them by their substrings."""
    place = np.full(len(text), -1, np.int64)
    place[lms] = np.arange(len(lms))
    ranked = place[rough]
    ranked = ranked[ranked >= 0]
    ends = np.append(lms[1:], len(text) - 1)
    a, b = lms[ranked[:-1]], lms[ranked[1:]]
    length = ends[ranked[:-1]] - a
    same = length == ends[ranked[1:]] - b
    left, at = np.flatnonzero(same), 0
    while len(left):  # substrings are short; each round drops those that have ended or differ
        equal = text[a[left] + at] == text[b[left] + at]
        same[left[~equal]] = False
        left = left[equal & (length[left] > at)]
        at += 1
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] + 1 == len(lms):
        return ranked
    reduced = np.empty(len(lms), np.int64)
    reduced[ranked] = names
    return suffix_array(reduced, sparse)


def shared_starts(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Positions whose first ``length`` symbols also begin at another position.

    The common prefix of each suffix with the one before it in ``order`` is found in text order, the
    permuted array: behind a prefix of p symbols the next one has p - 1 at least, so a run of starts is
    compared once from its first symbol and then extended by whole blocks.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    # a position whose predecessor is one behind that of the position before continues a run
    fresh = np.ones(n, bool)
    fresh[1:] = before[1:] != before[:-1] + 1
    fresh[order[0]] = True
    run = np.flatnonzero(fresh)
    ends = np.append(run[1:], n)
    run, ends = run[before[run] >= 0], ends[before[run] >= 0]
    out = np.zeros(n, bool)
    while len(run):
        # common prefix at a run's first position; it falls by one with each step of the run
        prefix, left = np.zeros(len(run), np.int64), np.arange(len(run))
        most = np.minimum(length + ends - run, n - np.maximum(run, before[run]))
        while len(left):
            left = left[prefix[left] < most[left]]
            left = left[text[run[left] + prefix[left]] == text[before[run[left]] + prefix[left]]]
            prefix[left] += 1
        count = np.clip(prefix - length + 1, 0, ends - run)  # starts of the run that reach ``length``
        found = np.repeat(run, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[found] = True
        out[before[found]] = True
        run = run + prefix + 1  # behind the mismatch the run says nothing yet
        run, ends = run[run < ends], ends[run < ends]
    return out
