"""Links between texts whose sets of shingles are similar, by SimHash fingerprints of these sets in Gray order.

A set's fingerprint has CODE bits. Two sets of Jaccard similarity t differ in each bit with the chance that the angle between
them gives; so the chance that two of them agree on some of a number of drawn masks is known, and as many masks are drawn
as find pairs at the threshold with chance RECALL, more similar ones more surely. Texts that agree on a mask make up a
group; in a group a Gray-order hierarchical index finds each text's nearest fingerprint within a radius that a pair at the
threshold exceeds once in two thousand times. Pairs so found are compared by whole sets. What fingerprints can't show, some
pairs near the threshold and all but the nearest, is left to prefixes.py, which loses none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import cut, few_rows, free_name, lean, ship
from tidemark.llm.gray import QUERIES, GrayIndex

#: Rows of a few longs of which a list may be broadcast.
FEW = 200_000
#: Longs of a fingerprint, and bits.
WORDS = 2
CODE = 64 * WORDS
#: The chance to find a pair at the threshold; the chance that the radius loses one.
RECALL, BEYOND = 0.95, 0.0005
#: Masks at most: what more would find in tables of many millions of texts is left to the prefixes, at less cost.
MASKS = 24
#: Unlike texts in a group on average; texts of a group that are compared in one task.
LOAD, GROUP = 512, 4096
#: Longs of a set's parities: bit h mod 512 is the parity of its hashes h.
PARITIES = 8
_EPS = 1e-9
_ADD = np.uint64(0xD1B54A32D192ED03)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_BYTE_AT = (np.arange(8 * WORDS) * 256).astype(np.intp)


def shingle_sets(texts: pa.Array, shingle: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text's lower-cased words as sorted 64-bit hashes; fewer words than a shingle make up one."""
    own, bounds = words.hashes(texts)
    rolled = own[: max(0, len(own) - shingle + 1)]
    for j in range(1, shingle):
        rolled = words.mixed(rolled + _ADD) + own[j : j + len(rolled)]
    rolled = words.mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= shingle:
            own_set = np.sort(rolled[a : b - shingle + 1])
            out.append(own_set[np.concatenate(([True], own_set[1:] != own_set[:-1]))])
        else:
            short = np.array([b - a], np.uint64)
            for w in own[a:b]:
                short = words.mixed(short + _ADD) + w
            out.append(short)
    return out


def code_of(found: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of hashes, WORDS longs: bits that are set in over half of the hashes."""
    wide = np.stack([found, *[words.mixed(found + np.uint64(k * int(_ADD) % 2**64)) for k in range(1, WORDS)]], axis=1)
    cells = np.add(wide.view(np.uint8), _BYTE_AT, dtype=np.intp)
    counts = np.bincount(cells.ravel(), minlength=256 * 8 * WORDS).reshape(8 * WORDS, 256).astype(np.float64) @ _BYTE_BITS
    return np.packbits((2 * counts.ravel() > len(found)).astype(np.uint8), bitorder="little").view(np.int64)


def parities_of(found: np.ndarray, size: int) -> np.ndarray:
    """size bits, a power of two: bit h mod size is the parity of the set's hashes h."""
    return np.packbits((np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little")


def with_sets(docs: DataFrame, names: list[str], prefix: Callable[[np.ndarray], np.ndarray], shingle: int = 5, text: str = "text") -> DataFrame:
    """docs with five columns of these names: 16 bytes that are equal where the sets of shingles are (XXH3 over the
    hashes); the outline, array<long>: the size of the set and PARITIES longs of its parities; its fingerprint, array<long>; what
    prefix gives of its hashes, array<long>; and as many parities as tell large sets apart, binary: twice the set's size or more."""
    ship(docs.sparkSession)
    source = docs.withColumn(free_name(docs, "hashed_text"), F.col(f"`{text}`").cast("string"))
    types = ("binary", "array<long>", "array<long>", "array<long>", "binary")
    schema = docs.withColumns({n: F.lit(None).cast(t) for n, t in zip(names, types, strict=True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        longs = pa.list_(pa.int64())
        for b in batches:
            digests, outlines, codes, prefixes, parities = [], [], [], [], []
            for found in shingle_sets(b.column(b.num_columns - 1), shingle):
                odd = parities_of(found, max(64 * PARITIES, 1 << (2 * len(found) - 1).bit_length()))
                digests.append(xxh3_128_digest(found.tobytes()))
                outlines.append(np.concatenate(([len(found)], folded(odd, 8 * PARITIES).view(np.int64))))
                codes.append(code_of(found))
                prefixes.append(prefix(found).view(np.int64))
                parities.append(odd.tobytes())
            made = (pa.array(digests, pa.binary()), *(pa.array(x, longs) for x in (outlines, codes, prefixes)), pa.array(parities, pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=schema.names)

    return source.mapInArrow(lean(run), schema)


def folded(odd: np.ndarray, size: int) -> np.ndarray:
    """Parities as fewer bytes."""
    return np.bitwise_xor.reduce(odd.reshape(-1, size), axis=0)


def needed(n: np.ndarray | int, m: np.ndarray | int, similarity: float) -> np.ndarray | float:
    """The least overlap of similar sets of n and m."""
    return similarity / (1 + similarity) * (n + m) - _EPS


def _differing(bits: int, similarity: float) -> np.ndarray:
    """The chance of each number of differing bits between fingerprints of sets at a similarity."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    log = [math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) for d in range(bits + 1)]
    return np.array([math.exp(x + d * math.log(p) + (bits - d) * math.log1p(-p)) if p else float(d == 0) for d, x in enumerate(log)])


def found_by(masks: int, width: int, similarity: float) -> float:
    """The chance that fingerprints of sets at a similarity agree on one of masks masks of width bits."""
    d, agree = np.arange(CODE + 1), np.ones(CODE + 1)
    for i in range(width):
        agree *= np.maximum(CODE - d - i, 0) / (CODE - i)
    return float(_differing(CODE, similarity) @ (1 - (1 - agree) ** masks))


def drawn_masks(n: int, similarity: float) -> list[list[int]]:
    """The bits of each mask for n texts: so many bits that LOAD unlike texts agree, so many masks, MASKS at most, that RECALL is met."""
    width, count = max(0, round(math.log2(max(n, 1) / LOAD))), 1
    while count < MASKS and found_by(count, width, similarity) < RECALL:
        count += 1
    rng = np.random.default_rng(1)
    return [sorted(rng.choice(CODE, width, replace=False).tolist()) for _ in range(count)]


def radius_of(similarity: float) -> int:
    """The number of differing bits that sets at a similarity exceed with chance BEYOND at most."""
    return int(np.searchsorted(np.cumsum(_differing(CODE, similarity)), 1 - BEYOND))


def _keys(masks: list[list[int]]) -> Column:
    """An array of keys, one for each mask: a hash of its number and of the bits that it selects."""
    out = []
    for t, bits in enumerate(masks):
        longs = [sum(1 << (b % 64) for b in bits if b // 64 == w) for w in range(WORDS)]
        out.append(F.xxhash64(F.lit(t), *[F.col("code")[w].bitwiseAND(F.lit(x - (1 << 64) if x >> 63 else x).cast("long")) for w, x in enumerate(longs) if x]))
    return F.array(*out)


def grouped(columns: list[str], of: int, each: Callable[[list[np.ndarray], np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable:
    """Rows sorted by the first of columns come in; each(columns, starts, sizes) is asked with whole groups of them."""

    def ask(held: list[np.ndarray]) -> pa.RecordBatch:
        new = np.any([c[1:] != c[:-1] for c in held[:of]], axis=0)
        starts = np.flatnonzero(np.concatenate(([True], new)))
        return each(held, starts, np.diff(np.append(starts, len(held[0]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            got = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            if not len(held[0]):
                continue
            same = np.all([c == c[-1] for c in held[:of]], axis=0)
            at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if at:
                yield ask([c[:at] for c in held])
                held = [c[at:].copy() for c in held]
        if held is not None and len(held[0]):
            yield ask(held)

    return run


def _nearest(radius: int) -> Callable:
    """Rows (key, part, id, codes) sorted by key, part come in; (u, v) go out, each row with the nearest one of its part, the
    least id of several, if any is within the radius."""
    names = ["key", "part", "id", *[f"c{k}" for k in range(WORDS)]]

    def each(rows: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        ids, codes = rows[2], np.array(rows[3:]).view(np.uint64)
        found = [np.zeros((2, 0), np.int64)]
        for at, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            index = GrayIndex(codes[:, at : at + size])
            for first in range(at, at + size, QUERIES):
                q, j, bits = index.search(codes[:, first : min(first + QUERIES, at + size)], radius)
                q, j = q + first, j + at
                other = q != j
                q, j, bits = q[other], j[other], bits[other]
                order = np.lexsort((ids[j], bits, q))
                q, j = q[order], j[order]
                new = np.flatnonzero(np.diff(q, prepend=-1))
                found.append(np.array([ids[q[new]], ids[j[new]]]))
        both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

    return grouped(names, 2, each)


def parities_fit(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sizes and parities differ no more than those of similar sets can; sets: id, n, parity."""
    met = pairs.join(sets.select(F.col("id").alias("u"), F.col("n"), F.col("parity").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("parity").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            least = needed(n, m, similarity)
            fit = np.minimum(n, m) >= least
            for i in np.flatnonzero(fit).tolist():
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in ("a", "b"))
                size = min(len(a), len(b))
                fit[i] = np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(dtype=np.int64) <= n[i] + m[i] - 2 * least[i]
            yield batch.select(["u", "v"]).filter(pa.array(fit))

    return met.select("u", "v", "n", "m", "a", "b").mapInArrow(lean(run), "u long, v long")


def ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids of pairs (u, v)."""
    return pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def asked(texts: DataFrame, ids: DataFrame, few: int = FEW) -> DataFrame:
    """The rows of texts whose id is in the distinct ids: up to few go to every task, more are joined by shuffling."""
    return texts.join(few_rows(ids.select("id"), few), "id", "left_semi")


def without(rows: DataFrame, ids: DataFrame, few: int = FEW) -> DataFrame:
    """rows but those whose id, the one column of ids, is in ids; lists go as in asked()."""
    return rows.join(few_rows(ids, few), ids.columns[0], "left_anti")


def fingerprint_links(nodes: DataFrame, check: Callable[[DataFrame], DataFrame], similarity: float = 0.8, group: int = GROUP, few: int = FEW) -> DataFrame:
    """Links (u, v) between the ids of nodes (id long from 0 up, code): of each text and its nearest one in each of its groups,
    the pairs that are similar by check, which is given distinct pairs.

    Groups of more than twice group texts are dealt to parts by chance.
    """
    ship(nodes.sparkSession)
    compared = [f"c{k}" for k in range(WORDS)]
    keyed = nodes.select("id", *[F.col("code")[k].alias(c) for k, c in enumerate(compared)], F.explode(_keys(drawn_masks(nodes.count(), similarity))).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * group).select("key", F.expr(f"n div {group} + 1").alias("parts"))
    part = F.coalesce(F.expr("pmod(xxhash64(id), parts)"), F.lit(0).cast("long"))
    dealt = keyed.join(few_rows(hot, few), "key", "left").select("key", part.alias("part"), "id", *compared)
    sorted_ = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    return cut(check(cut(sorted_.mapInArrow(lean(_nearest(radius_of(similarity))), "u long, v long").distinct())))
