"""Words of an Arrow batch of texts as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, bounds): text i has words bounds[i] to bounds[i + 1]; null texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return flat.filter(real), before[ends - ends[0]]


#: Bytes of words that are hashed together.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SPACE = np.zeros(256, np.bool_)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A number for each byte, one for a letter in either case.
_OF_BYTE = np.random.default_rng(23).integers(0, 1 << 64, 256, dtype=np.uint64)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Longs (uint64) spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64; up to CHUNK they are kept."""
    if n <= CHUNK and base in _powers:
        return _powers[base][: n + 1]
    steps = np.full(max(n, CHUNK) + 1, base, np.uint64)
    steps[0] = 1
    have = np.cumprod(steps)
    if n <= CHUNK:
        _powers[base] = have
    return have[: n + 1]


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, capitals A to Z as small letters; bounds as in split())."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    # a word begins after space or at the start of a text, and ends before space or at the end of one
    edge = np.zeros(len(raw) + 1, np.bool_)
    edge[offsets] = True
    space = _SPACE[raw]
    inside = ~space
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], space[:-1])) if len(raw) else inside))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((space[1:], [True])) if len(raw) else inside)) + 1
    out = np.zeros(len(starts), np.uint64)
    inverse, at = pow(_BASE, -1, 1 << 64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        own = raw[starts[at] : ends[end - 1]]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_OF_BYTE[own] * _power(_BASE, len(own))[: len(own)], out=sums[1:])
        a, b = starts[at:end] - starts[at], ends[at:end] - starts[at]
        out[at:end] = mixed((sums[b] - sums[a]) * _power(inverse, len(own))[a] + (b - a).astype(np.uint64))
        at = end
    return out, np.searchsorted(starts, offsets)


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values between neighbouring bounds."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def chunks(bounds: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs (first, end) of texts with at most most words, or of one text alone."""
    out, first = [], 0
    for i in range(1, len(bounds)):
        if bounds[i] - bounds[first] > most and i - 1 > first:
            out.append((first, i - 1))
            first = i - 1
    if first < len(bounds) - 1:
        out.append((first, len(bounds) - 1))
    return out
