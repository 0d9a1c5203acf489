"""Suffix arrays over integer symbols, by prefix doubling in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sa, ranks): the suffixes in order of their first depth symbols (all if None), and ranks[m], by which two places are
    equal if and only if their next 2**m symbols are. Suffixes that are alone in their group are not sorted again.

    A symbol that must not match, such as a separator, has to be unique. Past the end, suffixes are unlike.
    """
    sa = np.argsort(symbols, kind="stable")
    rank = _group(sa, symbols[sa], np.zeros(len(symbols), np.int32))
    ranks = [rank]
    for rank in refined(sa, rank, 1, depth):
        ranks.append(rank)
    return sa, ranks


def refined(sa: np.ndarray, rank: np.ndarray, width: int, depth: int | None = None) -> Iterator[np.ndarray]:
    """Ranks by twice as many symbols, and again, until depth or all suffixes are told apart; sa is put in order in place."""
    n = len(sa)
    open_ = _shared(sa, rank)
    while len(open_) and (depth is None or width < depth):
        at = sa[open_]
        ahead = at + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sa[open_] = at = at[order]
        key = key[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) | (key % (n + 1) == 0)
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank = rank.copy()
        rank[at] = open_[start]
        yield rank
        width *= 2
        same = ~new
        keep = same.copy()
        keep[:-1] |= same[1:]
        open_ = open_[keep]


def _group(sa: np.ndarray, ordered: np.ndarray, out: np.ndarray) -> np.ndarray:
    if len(sa):
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        out[sa] = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
    return out


def _shared(sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rows of sa whose suffix is not alone in its group."""
    if not len(sa):
        return np.zeros(0, np.int64)
    r = rank[sa]
    same = np.concatenate((r[1:] == r[:-1], [False]))
    same[1:] |= same[:-1].copy()
    return np.flatnonzero(same)


def adjacent_lcp(sa: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """lcp[i]: the symbols that suffixes sa[i - 1] and sa[i] share at their start; lcp[0] is 0."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    pairs = np.flatnonzero(ranks[0][sa[1:]] == ranks[0][sa[:-1]]) + 1
    a, b = sa[pairs - 1].copy(), sa[pairs].copy()
    got = np.zeros(len(pairs), np.int64)
    for m in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = inside & (ranks[m][np.minimum(a, n - 1)] == ranks[m][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << m
        a += step
        b += step
        got += step
    lcp[pairs] = got
    return lcp


def longest_repeats(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place, the length of the deepest LCP interval that holds its suffix: its longest repeated substring."""
    out = np.zeros(len(sa), np.int64)
    out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span (start, length)."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0
