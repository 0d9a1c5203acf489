"""A hierarchical index over bit patterns in Gray order."""

from __future__ import annotations

import numpy as np

FAN = 16
#: Patterns that are looked up together.
QUERIES = 64


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where a bit pattern stands in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_order(codes: np.ndarray) -> np.ndarray:
    """The places of codes (words, n), the first word the highest, by Gray rank; equal ones stay in order."""
    ranks, flip = [], np.zeros(codes.shape[1], np.uint64)
    for word in codes:
        rank = gray_rank(word) ^ flip
        flip = -(rank & np.uint64(1))
        ranks.append(rank)
    return np.lexsort(ranks[::-1])


class GrayIndex:
    """Hierarchical index over bit patterns (words, n) or (n), uint64, sorted by Gray rank.

    The lowest level holds the patterns. A node of a level holds what its FAN children share: a mask, the bits on which all
    agree, and a value, those bits. own is the part of the mask that the parent lacks, so that differences add up.
    """

    def __init__(self, codes: np.ndarray):
        codes = np.atleast_2d(codes)
        self.order = gray_order(codes)
        leaf = codes[:, self.order]
        self.values, masks = [leaf], [np.full(leaf.shape, np.uint64(0xFFFFFFFFFFFFFFFF))]
        ones, either = leaf, leaf
        while ones.shape[1] > FAN:
            cuts = np.arange(0, ones.shape[1], FAN)
            ones, either = np.bitwise_and.reduceat(ones, cuts, axis=1), np.bitwise_or.reduceat(either, cuts, axis=1)
            masks.append(~(ones ^ either))
            self.values.append(ones & masks[-1])
        self.own = [m & ~np.repeat(up, FAN, axis=1)[:, : m.shape[1]] for m, up in zip(masks, masks[1:], strict=False)] + [masks[-1]]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, place in the codes given, bits that differ) of every code within radius of a query."""
        queries = np.atleast_2d(queries)
        top = len(self.values) - 1
        n, roots = queries.shape[1], self.values[top].shape[1]
        q, node = np.repeat(np.arange(n), roots), np.tile(np.arange(roots), n)
        seen = np.zeros(len(q), np.int16)
        for level in range(top, -1, -1):
            if level < top:
                q, seen = np.repeat(q, FAN), np.repeat(seen, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < self.values[level].shape[1]
                q, seen, node = q[real], seen[real], node[real]
            for word, value, own in zip(queries, self.values[level], self.own[level], strict=True):
                seen = seen + np.bitwise_count((word[q] ^ value[node]) & own[node])
            near = seen <= radius
            q, seen, node = q[near], seen[near], node[near]
        return q, self.order[node], seen
