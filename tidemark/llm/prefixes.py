"""The pairs of similar texts that no links join yet: an exact join by prefixes of their sets of shingles.

Sets of Jaccard similarity t or more share one of the first n - ceil(t * n) + 1 of their n shingles in any order that is the
same for all sets. The order here puts shingles of many texts last, by counts from a sample, and goes by hash among others;
so texts meet at rare shingles, and no choice of it loses a pair. Of the texts at a shingle those outside its largest
component are asked against all others, by bounds that no similar pair exceeds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_path, few_rows, lean, saved_at, ship
from tidemark.llm.similar import FEW, PARITIES, grouped, needed, shingle_sets

#: One text of so many is sampled for common shingles; a shingle that so many sampled texts have is one.
SAMPLE, COMMON = 32, 4
#: Texts at a common shingle that are compared in one task.
GROUP = 1024
#: Pairs that are compared at once.
ROOM = 1 << 18
_EPS = 1e-9


def _hashed(shingle: int) -> Callable:
    """Rows (text) come in; their distinct shingles (key) go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["key"])

    return run


def common_shingles(texts: DataFrame, shingle: int, sample: int = SAMPLE, least: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Up to FEW shingles that at least least of the sampled distinct texts have: sorted hashes, and in how many."""
    ship(texts.sparkSession)
    some = texts.filter(F.expr(f"pmod(xxhash64(text), {sample}) = 0")).select("text").distinct()
    counts = some.mapInArrow(lean(_hashed(shingle)), "key long").groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
    found = counts.orderBy(F.desc("c"), "key").limit(FEW).toArrow()
    keys, c = found.column("key").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], c[order]


def prefix_of(common, similarity: float) -> Callable[[np.ndarray], np.ndarray]:
    """A function from a set, as sorted hashes, to its prefix; common broadcasts what common_shingles() gave."""

    def prefix(found: np.ndarray) -> np.ndarray:
        keys, counts = common.value
        n = len(found)
        take = n - math.ceil(similarity * n - _EPS) + 1
        if len(keys):
            where = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hot = keys[where] == found
            if hot.any():
                return found[np.argsort(np.where(hot, counts[where], 0), kind="stable")[:take]]
        return found[:take]

    return prefix


def _may(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m may be similar whose first shared shingle stands at p and q."""
    return 1 + np.minimum(n - p - 1, m - q - 1) >= needed(n, m, similarity)


def _meeting() -> Callable:
    """Rows (key, part, id, n, place, root) sorted by key, part come in; those of keys dealt to parts go out, and those of
    other keys with several roots."""

    def each(rows: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        part, root = rows[1], rows[5]
        several = np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts)
        keep = np.repeat(several, sizes) | (part >= 0)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (rows[0], *rows[2:])], names=["key", "id", "n", "place", "root"])

    return grouped(["key", "part", "id", "n", "place", "root"], 2, each)


def _apart(similarity: float) -> Callable:
    """Rows sorted by key, part come in; the pairs (u, v) that aren't joined yet and may be similar go out.

    asks: whether a row is held against the others of its part; given: whether it is one of these.
    """
    names = ["key", "part", "id", "n", "place", "root", "asks", "given", *[f"p{k}" for k in range(PARITIES)]]

    def each(rows: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        ids, n, place, root, asks, given = rows[2:8]
        bits = np.array(rows[8:]).view(np.uint64)
        found = [np.zeros((2, 0), np.int64)]

        def compare(a: np.ndarray, b: np.ndarray) -> None:
            ok = (root[a] != root[b]) & _may(n[a], n[b], place[a], place[b], similarity)
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(bits[:, a] ^ bits[:, b]).sum(axis=0, dtype=np.int64) <= n[a] + n[b] - 2 * needed(n[a], n[b], similarity)
            found.append(np.array([ids[a[ok]], ids[b[ok]]]))

        # each row that asks with every row of its group that is given, about ROOM pairs at once
        asking, of = np.flatnonzero(asks), np.repeat(np.arange(len(starts)), sizes)
        targets = np.flatnonzero(given)
        first, last = np.searchsorted(of[targets], of[asking]), np.searchsorted(of[targets], of[asking], side="right")
        count = last - first
        ends = np.cumsum(count)
        at = 0
        while at < len(asking):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROOM, side="right")))
            own = count[at:end]
            begin = np.repeat(first[at:end] - np.concatenate(([0], np.cumsum(own)[:-1])), own)
            compare(np.repeat(asking[at:end], own), targets[begin + np.arange(len(begin))])
            at = end
        both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

    return grouped(names, 2, each)


def remaining_links(nodes: DataFrame, roots: DataFrame, common: tuple[np.ndarray, np.ndarray], check: Callable[[DataFrame], DataFrame], similarity: float = 0.8, sample: int = SAMPLE, group: int = GROUP, few: int = FEW) -> DataFrame:
    """Links (u, v) over the ids of nodes (id long from 0 up, outline, prefix) that, with those that made roots (id, root), join
    all that pairs of similarity or more join.

    check gives those of distinct pairs (u, v) that are similar; no pair is left out but by bounds that similar ones can't
    exceed, or because links join it already. Texts at a common shingle are dealt to parts of about group texts; those that ask
    go to each part.
    """
    spark = nodes.sparkSession
    ship(spark)
    keys, counts = common
    parts = 1 + counts * sample // group
    many = parts > 1
    hot = spark.createDataFrame(pa.table({"key": keys.view(np.int64)[many], "cuts": parts[many].astype(np.int64)})) if many.any() else spark.createDataFrame([], "key long, cuts long")
    own_part = F.expr("pmod(xxhash64(id), cuts)")
    rooted = nodes.join(few_rows(roots, few), "id", "left").select("id", F.col("outline")[0].alias("n"), F.coalesce("root", "id").alias("root"), F.posexplode("prefix").alias("place", "key"))
    dealt = rooted.join(F.broadcast(hot), "key", "left").select("key", F.coalesce(own_part, F.lit(-1).cast("long")).alias("part"), "id", "n", F.col("place").cast("long").alias("place"), "root")
    sorted_ = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    met, path = saved_at(sorted_.mapInArrow(lean(_meeting()), "key long, id long, n long, place long, root long"), "met")
    kinds = met.groupBy("key", "root").agg(F.count("*").alias("c"))
    largest = kinds.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("size"), F.count("*").alias("kinds"))
    open_ = largest.filter("kinds > 1").select("key", "main", F.expr(f"size div {group} + 1").alias("parts"))
    left = met.join(few_rows(open_, few), "key").withColumn("asks", F.expr("root != main")).withColumn("own", F.expr("pmod(xxhash64(id), parts)"))
    sent = left.select("*", F.explode(F.when(F.col("asks"), F.expr("sequence(0L, parts - 1)")).otherwise(F.array("own"))).alias("part")).withColumn("given", F.expr("part = own"))
    odd = [F.col("outline")[1 + k].alias(f"p{k}") for k in range(PARITIES)]
    rows = sent.join(nodes.select("id", "outline"), "id").select("key", "part", "id", "n", "place", "root", "asks", "given", *odd)
    pairs = rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(lean(_apart(similarity)), "u long, v long")
    found = cut(check(cut(pairs.distinct())))
    drop_path(spark, path)
    return found
